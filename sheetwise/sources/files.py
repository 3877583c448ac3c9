"""Readers and writers of the file forms that reviews come in: CSV sheets, cost logs, folders, JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.operators.batch import cost_sums

NOTES = {"Standard": "standard", "Content": "content", "Category": "category", "Compressor_Series": "compressor_series", "Applicability": "applicability"}
PARTS = {"Part": "part", "Mandatory_Standards": "mandatory"}
COST_LOG = ("timestamp", "modelo", "total_tokens", "prompt_tokens", "completion_tokens", "latencia_ms", "custo_usd")


def _sheet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by name; one that the file lacks is null. ``ord`` follows the order of files and rows."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    picked = [(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(name) for c, name in columns.items()]
    return raw.select(F.monotonically_increasing_id().alias("ord"), *picked)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return _sheet(spark, path, NOTES)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return _sheet(spark, path, PARTS)


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as text, with ``call_id``; operators cast what parses."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in COST_LOG))
    return raw.select(F.monotonically_increasing_id().alias("call_id"), *COST_LOG)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, path: str) -> set[str]:
    """Ids of the batches below ``path`` that were written to their end."""
    fs, place = _folder(spark, path)
    found = [f.getPath() for f in fs.listStatus(place)] if fs.exists(place) else []
    return {p.getName().removeprefix("batch=") for p in found if p.getName().startswith("batch=") and fs.exists(_folder(spark, f"{p}/_SUCCESS")[1])}


def append_log(calls: DataFrame, path: str, batch_id: str) -> bool:
    """Append the log rows of ``calls`` under ``batch_id``, once: whether anything was written.

    A batch that was written to its end isn't written again, so a repeated job adds nothing; one that a failed job left unfinished is replaced.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch_id):
        raise ValueError("a batch id has letters, digits, _ and -")
    if batch_id in committed(calls.sparkSession, path):
        return False
    calls.select(*COST_LOG).write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch_id}")
    return True


def read_batches(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """The rows of ``batches`` of a log as text, with ``call_id`` and ``batch``; other batches aren't read."""
    kinds = ", ".join(f"{c} string" for c in COST_LOG) + ", batch string"
    raw = spark.read.option("basePath", path).csv([f"{path}/batch={b}" for b in batches], header=True, schema=kinds)
    return raw.select(F.monotonically_increasing_id().alias("call_id"), *COST_LOG, "batch")


def summed_increments(spark: SparkSession, log: str, state: str) -> DataFrame:
    """Sums of each batch of the log, as of ``batch.cost_sums``, kept at ``state``: only batches that it lacks are read.

    Each batch has its own row at ``state``, under its id; what a failed job left unfinished is made again.
    """
    for b in sorted(committed(spark, log) - committed(spark, state)):
        cost_sums(read_batches(spark, log, [b])).write.mode("overwrite").parquet(f"{state}/batch={b}")
    done = sorted(committed(spark, state))
    kinds = "calls bigint, tokens bigint, usd double, ms double"
    if not done:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(*(f"{state}/batch={b}" for b in done))


def list_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, name) of the PDF files below ``folder``; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"))


def write_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines; nulls are written."""
    records.write.option("ignoreNullFields", "false").json(path)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """A sheet as CSV in a new place; the sheet that was read stays."""
    sheet.write.csv(path, header=True)
