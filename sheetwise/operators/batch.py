"""Batches of drawings: listings, revision pairs, stored answers, sheets, costs and summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import text as T


def drawing_listing(files: DataFrame) -> DataFrame:
    """(folder, folder_no, name, pos): drawings of each folder in name order; a folder that is no number counts as 0."""
    here = Window.partitionBy("folder").orderBy("name")
    return files.select("folder", F.coalesce(F.col("folder").cast("string").try_cast("int"), F.lit(0)).alias("folder_no"), "name", F.row_number().over(here).alias("pos"))


def battery_grouping(files: DataFrame) -> DataFrame:
    """(stem, original, review, draw_1, draw_2, vs, kind): test pairs and trios by the naming rule."""
    shape = r"(?i)^(.*)_(original|review|draw_1|draw_2|vs)\.pdf$"
    roles = ["original", "review", "draw_1", "draw_2", "vs"]
    named = files.where(F.rlike("name", F.lit(shape))).select(F.regexp_extract("name", shape, 1).alias("stem"), F.lower(F.regexp_extract("name", shape, 2)).alias("role"))
    wide = named.groupBy("stem").pivot("role", roles).count()
    wide = wide.select("stem", *(F.coalesce(r, F.lit(0)).alias(r) for r in roles))
    trio = (F.col("draw_1") > 0) & (F.col("draw_2") > 0) & (F.col("vs") > 0)
    pair = (F.col("original") > 0) & (F.col("review") > 0)
    return wide.withColumn("kind", F.when(trio, "trio").when(pair, "pair").otherwise("incomplete"))


def drawing_pairs(files: DataFrame) -> DataFrame:
    """(folder, n_files, first, second, error, extra): the two revisions in each folder."""
    marked = lambda m: F.min(F.when(F.lower("name").contains(m), F.col("name")))
    ranked = files.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("name")))
    nth = lambda k: F.min(F.when(F.col("nth") == k, F.col("name")))
    g = ranked.groupBy("folder").agg(F.count("*").alias("n_files"), marked("draw_1").alias("a"), marked("draw_2").alias("b"), nth(1).alias("n1"), nth(2).alias("n2"))
    few, both = F.col("n_files") < 2, F.col("a").isNotNull() & F.col("b").isNotNull()
    pick = lambda x, y: F.when(few, None).when(both, F.col(x)).otherwise(F.col(y))
    return g.select("folder", "n_files", pick("a", "n1").alias("first"), pick("b", "n2").alias("second"), F.when(few, "fewer than two drawings").alias("error"), (F.col("n_files") > 2).alias("extra"))


def page_pairs(pages: DataFrame) -> DataFrame:
    """(pair_id, page, differing): pages that both revisions have; the flag tells differing page counts."""
    counts = pages.groupBy("pair_id").agg(F.max(F.when(F.col("rev") == 1, F.col("page"))).alias("n1"), F.max(F.when(F.col("rev") == 2, F.col("page"))).alias("n2"))
    own = pages.groupBy("pair_id", "page").agg(F.count_distinct("rev").alias("revs")).where("revs = 2")
    return own.join(counts, "pair_id").select("pair_id", "page", (F.col("n1") != F.col("n2")).alias("differing"))


FIELD = "struct<value:string,evidence:string,confidence:double>"
FIELDS = ("document_type", "component", "material_family", "compressor_series")
RESPONSE = "struct<" + ",".join(f"{f}:{FIELD}" for f in FIELDS) + ",cited_standards:array<struct<standard:string,evidence:string>>>"


def response_ingest(responses: DataFrame) -> DataFrame:
    """(doc_id, answer, violations): stored answers parsed by a fixed schema, with every rule they break; a confidence has to be given."""
    malformed = F.try_parse_json("response").isNull()

    def rules(answer):
        bad = [F.when(malformed, "malformed")]
        for f in FIELDS:
            x = answer[f]
            bad += [
                F.when(~malformed & x.isNull(), f"{f}: missing"),
                F.when(x.isNotNull() & ~F.coalesce(x["confidence"].between(0, 1), F.lit(False)), f"{f}: confidence"),
                F.when(F.length(x["evidence"]) > T.MAX_EVIDENCE, f"{f}: evidence too long"),
            ]
        cited = answer["cited_standards"]
        codes = F.transform(cited, lambda c: c["standard"])
        bad += [
            F.when(~malformed & cited.isNull(), "cited_standards: missing"),
            F.when(F.size(codes) > F.size(F.array_distinct(codes)), "cited_standards: repeated"),
            F.when(F.exists(cited, lambda c: F.length(c["evidence"]) > T.MAX_EVIDENCE), "cited_standards: evidence too long"),
        ]
        return F.array_compact(F.array(*bad))

    both = _once(F.from_json("response", RESPONSE), lambda a: F.struct(a.alias("answer"), rules(a).alias("violations")))
    return responses.select("doc_id", both.alias("both")).select("doc_id", "both.answer", "both.violations")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The fields of the stored answers of each kind.
SCHEMAS = {
    "classification": "classificacao string, justificativa string",
    "standards": "lista_normas array<string>, justificativas array<string>",
    "classification_and_standards": "classificacao string, justificativa_classificacao string, lista_normas array<string>, justificativas_normas array<string>",
    "missing_standards": "normas_sugeridas array<string>, reasoning string, confianca double",
    "difference": "parecer_geral string, analise_faltantes array<struct<norma:string,impacto:string>>, analise_extras array<struct<norma:string,avaliacao:string>>, conformidade_percentual double",
}


def _rules(response: str, kind: str) -> Column:
    """The rules of one of SCHEMAS that an answer breaks."""
    fields = dict(f.split(" ", 1) for f in re.split(r", (?=\w+ (?:string|double|array))", SCHEMAS[kind]))
    reasons = [f for f in fields if f.startswith("justificativas")]
    codes = [f for f in fields if f in ("lista_normas", "normas_sugeridas")]

    def rules(answer):
        own = {f: answer[f] for f in fields}
        bad = [F.when(own[f].isNull(), f"{f}: missing") for f in fields]
        for f, t in fields.items():
            if t.startswith("array<struct"):
                parts = re.findall(r"(\w+):", t)
                bad.append(F.when(F.exists(own[f], lambda x: reduce(Column.__or__, (x[c].isNull() for c in parts))), f"{f}: incomplete"))  # noqa: B023
        bad += [F.when(F.size(own[a]) != F.size(own[b]), f"{a}: unequal length") for a, b in zip(codes, reasons)]
        bad += [F.when(F.size(own[f]) > F.size(F.array_distinct(own[f])), f"{f}: repeated") for f in codes]
        bad += [F.when(~own[f].between(0, 1), f"{f}: confidence") for f in fields if f == "confianca"]
        return F.array_compact(F.array(*bad))

    return F.when(F.try_parse_json(response).isNull(), F.array(F.lit("malformed"))).otherwise(_once(F.from_json(response, SCHEMAS[kind]), rules))


def schema_ingest(responses: DataFrame, kind: str) -> DataFrame:
    """(doc_id, answer, violations): stored answers of one of SCHEMAS, with every rule they break.

    All fields are required, also those of list items; codes don't repeat; a list of reasons is as
    long as its list of codes; a confidence is from 0 to 1. What isn't JSON is malformed.
    """
    return responses.select("doc_id", F.from_json("response", SCHEMAS[kind]).alias("answer"), _rules("response", kind).alias("violations"))


def kinds_ingest(responses: DataFrame) -> DataFrame:
    """(doc_id, kind, violations) of answers of all kinds in one scan, each by the rules of its ``kind``; an unknown kind is a violation."""
    found = F.array(F.lit("unknown kind"))
    for kind in reversed(SCHEMAS):
        found = F.when(F.col("kind") == kind, _rules("response", kind)).otherwise(found)
    return responses.select("doc_id", "kind", found.alias("violations"))


def valid(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.size("violations") == 0).drop("violations")


def quarantined(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.size("violations") > 0)


def result_writeback(sheet: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The sheet with ``columns`` of the result written into the first row of each key that has one.

    Columns that the sheet lacks aren't written; later rows of a key and keys without a result stay.
    A failed result writes its nulls. The output is a new table; nothing is written in place.
    """
    own = [c for c in columns if c in sheet.columns]
    new = results.select(key, *(F.col(c).alias(f"new_{c}") for c in own), F.lit(True).alias("has_result"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("row_no")) == 1
    joined = sheet.withColumn("is_first", first).join(new, key, "left")
    write = F.col("is_first") & F.col("has_result")
    return joined.select(*(F.when(write, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in sheet.columns))


def cost_log(raw: DataFrame, *keys: str) -> DataFrame:
    """The log, after ``keys``, with typed columns; what doesn't parse is null."""
    kinds = {"total_tokens": "bigint", "prompt_tokens": "bigint", "completion_tokens": "bigint", "latencia_ms": "double", "custo_usd": "double"}
    return raw.select(*keys, "call_id", "timestamp", "modelo", *(F.col(c).try_cast(k).alias(c) for c, k in kinds.items()))


def cost_rows(calls: DataFrame) -> DataFrame:
    """Log rows for calls, in the order of the log's columns: latency with 2 and cost with 6 decimals, as text; what is null stays empty."""
    return calls.select(
        "timestamp", "modelo", "total_tokens", "prompt_tokens", "completion_tokens",
        T.fixed(F.col("latencia_ms").cast("double"), 2).alias("latencia_ms"),
        T.fixed(T.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")), 6).alias("custo_usd"),
    )


def append_costs(calls: DataFrame, path: str) -> None:
    """Append the log rows to the CSV log at ``path``."""
    cost_rows(calls).write.mode("append").option("header", True).csv(path)


def cost_sums(raw: DataFrame, *by: str) -> DataFrame:
    """(by, calls, tokens, usd, ms): sums over log rows that sums of parts add up to.

    Cells are read from left to right and a row stops at its first malformed cell: its tokens count
    although its cost doesn't parse, its cost although its latency doesn't; only whole rows are calls.
    """
    t = cost_log(raw, *by)
    tokens = F.col("total_tokens").isNotNull()
    cost = tokens & F.col("custo_usd").isNotNull()
    whole = cost & F.col("latencia_ms").isNotNull()
    return t.groupBy(*by).agg(
        F.count_if(whole).alias("calls"), F.sum(F.when(tokens, F.col("total_tokens"))).alias("tokens"), F.sum(F.when(cost, F.col("custo_usd"))).alias("usd"), F.sum(F.when(whole, F.col("latencia_ms"))).alias("ms")
    )


def cost_total(sums: DataFrame) -> DataFrame:
    """(calls, tokens, cost, mean_latency) of rows of ``cost_sums``."""
    t = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "tokens")), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("usd", "ms")))
    mean = F.coalesce(F.try_divide(F.col("ms"), F.col("calls")), F.lit(0.0))
    return t.select("calls", "tokens", F.concat(F.lit("$"), T.fixed(F.col("usd"), 4)).alias("cost"), T.fixed(mean, 2).alias("mean_latency"))


def cost_summary(raw: DataFrame) -> DataFrame:
    """(calls, tokens, cost, mean_latency) of the log."""
    return cost_total(cost_sums(raw))


def drawing_token_totals(calls: DataFrame) -> DataFrame:
    """(drawing_id, input_tokens, output_tokens, latency): sums over the calls of a drawing."""
    return calls.groupBy("drawing_id").agg(F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"), F.round(F.sum("latency_ms"), 2).alias("latency"))


def batch_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, classified, errors, tokens and mean latency; nulls are skipped."""
    return calls.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("error").isNull()).alias("classified"), F.count("error").alias("errors"),
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"),
    )
