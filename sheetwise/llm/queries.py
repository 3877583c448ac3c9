"""The queries of the text operators, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import alignment, chat_format, decontaminate, language_id, license_scan, line_dedup, mixing, periodic_runs, quality, secret_scan, simhash, substring_dedup, token_count
from sheetwise.llm.common import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run fills the ledger; the second meets it and scans only what it lacks, here nothing."""
    docs = _table(spark, sf_dir, "documents")
    ledger = keep(secret_scan.scan_unseen(docs), "ledger")
    ledger = ledger.union(secret_scan.scan_unseen(docs, ledger))
    return secret_scan.digest(secret_scan.join_findings(docs, ledger, ["doc_id"]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_coverage(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.retrieve(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.where("verified").drop("verified")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.budget_answers(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_turns(turns.union(probe)))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find_licenses(_table(spark, sf_dir, "documents")))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.totals(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), periodic_runs.stretched))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_language_id, op3_quality_rules, op4_benchmark_decontamination, op5_line_dedup,
    op6_mixing, op7_simhash, op8_token_counts, op9_substring_dedup, op10_chat_formatting, op11_license_scans, op12_tokenizer_alignment, op13_periodic_runs,
)}

ORACLES = {"op5_line_dedup": line_dedup.ORACLE, "op11_license_scans": license_scan.ORACLE}
