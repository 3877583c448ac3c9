"""Site-relative line removal: drop lines that too many pages of their host share.

For each host, the pages that contain a line are counted once each and divided by the host's pages.
Lines above ``max_ratio`` that at least ``min_pages`` pages contain are boilerplate and are dropped.
Lines are compared without spaces, tabs and carriage returns at their ends; blank lines stay.
DataFrame functions only. Lines are counted by two independent 64-bit hashes, with a map-side
aggregate, so neither a host nor a line with a third of all rows gathers in one task.

Defined results: a null text stays null and has no lines; a null host is a host of its own; every
row is a page, also if rows or ids repeat; an empty table gives no rows; other columns are ignored. A line exactly at the
ratio stays. A very long text is split whole in its task; its boilerplate lines alone come back to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import free_name, keep

MAX_RATIO = 0.05
MIN_PAGES = 5


def _key(line) -> F.Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit("line")).alias("h2"))


def _trim(line) -> F.Column:
    return F.trim(line, F.lit(" \t\r"))


def _full(line) -> F.Column:
    return _trim(line) != ""


def _dropped(docs: DataFrame, host: str, max_ratio: float, min_pages: int, drop: str) -> DataFrame:
    """Add the column ``drop`` to ``docs``: the keys of the page's boilerplate lines, null if it has none.

    The lines come back to their page by its id and a hash of its row, so rows that repeat get the same.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), host, "text")
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _full), lambda x: _key(_trim(x))))
    pages = docs.select("doc_id", row.alias("row"), F.col(host).alias("host"), lines.alias("lines"))
    held = pages.select("doc_id", "row", "host", F.explode("lines").alias("line"))
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    # Lines that few pages contain are left out before the host's total is looked up.
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, counts.host.eqNullSafe(totals.host)).where(F.col("n") > max_ratio * F.col("pages")).select(counts.host.alias("its_host"), F.col("line").alias("its_line"))
    common = keep(common, "boilerplate")
    hit = held.join(common, F.col("host").eqNullSafe(F.col("its_host")) & (F.col("line") == F.col("its_line")))
    drops = hit.groupBy("doc_id", "row").agg(F.collect_set("line").alias(drop))
    its_id, its_row = free_name(docs, "its_id"), free_name(docs, "its_row")
    drops = drops.select(F.col("doc_id").alias(its_id), F.col("row").alias(its_row), drop)
    return docs.join(drops, F.col("doc_id").eqNullSafe(F.col(its_id)) & (row == F.col(its_row)), "left").drop(its_id, its_row)


def _kept(drop: str) -> F.Column:
    return F.filter(F.split("text", "\n"), lambda x: ~(_full(x) & F.array_contains(drop, _key(_trim(x)))))


def _cleaned(drop: str) -> F.Column:
    return F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(_kept(drop), "\n"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(doc_id, host, n_lines, n_dropped, text) of every row; n_lines counts the lines that aren't blank."""
    split = F.split("text", "\n")
    return _dropped(docs.select("doc_id", host, "text"), host, max_ratio, min_pages, "line_drop").select(
        "doc_id",
        F.col(host).alias("host"),
        F.coalesce(F.size(F.filter(split, _full)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("line_drop").isNull(), 0).otherwise(F.size(split) - F.size(_kept("line_drop"))).cast("long").alias("n_dropped"),
        _cleaned("line_drop").alias("text"),
    )


def clean(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the lines dropped from text; n_chars, where it exists, follows."""
    drop = free_name(docs, "line_drop")
    rows = _dropped(docs, host, max_ratio, min_pages, drop)
    changed = {"text": _cleaned(drop)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(_cleaned(drop)).cast(docs.schema["n_chars"].dataType))
    return rows.withColumns(changed).select(*docs.columns)


ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, text FROM documents),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p WHERE text IS NOT NULL),
t AS (SELECT rid, host, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT c.host, c.k FROM (SELECT host, k, count(DISTINCT rid) AS n FROM t WHERE k <> '' GROUP BY host, k) c
      JOIN n ON n.host IS NOT DISTINCT FROM c.host WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO} * n.pages),
m AS (SELECT t.rid, t.pos, t.line, t.k, b.k IS NOT NULL AS gone FROM t LEFT JOIN b ON b.host IS NOT DISTINCT FROM t.host AND b.k = t.k),
g AS (SELECT rid, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY rid)
SELECT p.doc_id, p.host, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped, g.text FROM p LEFT JOIN g USING (rid)
"""
