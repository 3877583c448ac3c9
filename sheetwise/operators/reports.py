"""Review answers: Markdown tables, their columns, the text around them, statuses and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import text as T

ITEM_HINTS, ZONE_HINTS, STATUS_HINTS = ("item",), ("localiza", "quadrante"), ("status",)
# The forms of a zone and of a range of zones.
TOKEN = r"(?:[A-Za-z]\d{1,2}|\d{1,2}[A-Za-z])"
RANGE = rf"(?i)\b({TOKEN})\s*(?:-|a)\s*({TOKEN})\b"


def _is_row(line):
    """A stripped line between pipes that isn't a separator."""
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")) & ~F.rlike(line, F.lit(r"^[-|: ]*$"))


def _cells(line):
    parts = F.split(line, r"\|", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), T.strip)


def markdown_rows(reports: DataFrame) -> DataFrame:
    """(doc_id, row_no, header_no, header, value): the body of the tables of each report, read as one table.

    Short rows are padded with empty values and further cells dropped; a header that repeats stands
    at its first place with the value of its last.
    """
    rows = F.filter(F.transform(F.split("report", "\n"), T.strip), _is_row)
    table = reports.select("doc_id", rows.alias("lines")).where(F.size("lines") > 1).select("doc_id", "lines", _cells(F.col("lines")[0]).alias("headers"))
    body = table.select("doc_id", "headers", F.posexplode(F.slice("lines", F.lit(2), F.size("lines") - 1)).alias("row_no", "line"))
    body = body.select("doc_id", "headers", "row_no", _cells(F.col("line")).alias("cells"))
    names = body.select("doc_id", "row_no", "headers", "cells", F.posexplode(F.array_distinct("headers")).alias("header_no", "header"))
    last = F.size("headers") - F.array_position(F.reverse("headers"), F.col("header")).cast("int")
    return names.select("doc_id", (F.col("row_no") + 1).alias("row_no"), F.col("header_no"), "header", F.coalesce(F.get("cells", last), F.lit("")).alias("value"))


def find_header(headers, hints):
    """First header that holds any of the hints, in any case; null if none does."""
    return F.get(F.filter(headers, lambda h: F.exists(F.array(*map(F.lit, hints)), lambda x: F.contains(F.lower(h), x))), F.lit(0))


def header_lookup(reports: DataFrame) -> DataFrame:
    """(doc_id, item_header, zone_header, status_header) of each report with a table."""
    rows = F.filter(F.transform(F.split("report", "\n"), T.strip), _is_row)
    headers = reports.select("doc_id", rows.alias("lines")).where(F.size("lines") > 0).select("doc_id", _cells(F.col("lines")[0]).alias("headers"))
    found = (("item_header", ITEM_HINTS), ("zone_header", ZONE_HINTS), ("status_header", STATUS_HINTS))
    return headers.select("doc_id", *(find_header(F.col("headers"), hints).alias(name) for name, hints in found))


def report_preamble(reports: DataFrame) -> DataFrame:
    """(doc_id, before, after): the lines around the table, joined by newlines; without a table all are before."""
    lines = F.split("report", "\n")
    between = F.transform(lines, lambda x: F.startswith(T.strip(x), F.lit("|")) & F.endswith(T.strip(x), F.lit("|")))
    t = reports.select("doc_id", lines.alias("lines"), between.alias("table")).withColumn("first", F.array_position("table", F.lit(True)).cast("int"))
    before = F.when(F.col("first") == 0, F.col("lines")).otherwise(F.slice("lines", F.lit(1), F.col("first") - 1))
    tail = F.filter(F.zip_with("lines", F.transform("table", lambda x, i: ~x & (F.col("first") > 0) & (i >= F.col("first"))), lambda x, keep: F.when(keep, x)), lambda x: x.isNotNull())
    return t.select("doc_id", F.array_join(before, "\n").alias("before"), F.array_join(tail, "\n").alias("after"))


def report_items(reports: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id, row_no, item, zone_text, status): a row for each item of each report.

    The three columns are found once in a report's header; rows are read where they stand, without a shuffle.
    """
    keys = (*keys, "doc_id")
    rows = F.filter(F.transform(F.split("report", "\n"), T.strip), _is_row)
    table = reports.select(*keys, rows.alias("lines")).where(F.size("lines") > 1).select(*keys, "lines", _cells(F.col("lines")[0]).alias("headers"))
    hints = {"item": ITEM_HINTS, "zone_text": ZONE_HINTS, "status": STATUS_HINTS}
    place = lambda h: F.size("headers") - F.array_position(F.reverse("headers"), h).cast("int")
    # Of a header that repeats, the last value counts; the place is null without the header.
    places = [place(find_header(F.col("headers"), hint)).alias(f"{name}_at") for name, hint in hints.items()]
    body = table.select(*keys, *places, F.posexplode(F.slice("lines", F.lit(2), F.size("lines") - 1)).alias("at", "line"))
    body = body.select(*keys, (F.col("at") + 1).alias("row_no"), *(f"{name}_at" for name in hints), _cells(F.col("line")).alias("cells"))
    value = lambda at: F.when(F.col(at).isNotNull(), F.coalesce(F.get("cells", at), F.lit("")))
    return body.select(*keys, "row_no", *(value(f"{name}_at").alias(name) for name in hints))


def status_summary(reports: DataFrame) -> DataFrame:
    """(status_class, n, pages): items of each class over all reports, and reports that have one."""
    items = report_items(reports).select("doc_id", T.status_class("status").alias("status_class"))
    return items.groupBy("status_class").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


def clean_cells(reports: DataFrame) -> DataFrame:
    """(doc_id, row_no, header_no, value, bullets): cell texts without marks, and their bullet lists."""
    value = T.report_text(F.col("value"))
    return markdown_rows(reports).select("doc_id", "row_no", "header_no", value.alias("value"), F.array_join(T.bullets(value), " / ").alias("bullets"))


def zone_groups(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, group_no, row_a, col_a, row_b, col_b): ranges first, then single zones; the second zone of a single is null."""
    text = F.coalesce("zone_text", F.lit(""))
    zone = lambda t: (T.zone_row(t), T.zone_column(t))
    starts, ends = F.regexp_extract_all(text, F.lit(RANGE), 1), F.regexp_extract_all(text, F.lit(RANGE), 2)
    ranges = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rest = F.regexp_replace(text, RANGE, " ")
    singles = F.transform(F.regexp_extract_all(rest, F.lit(rf"\b({TOKEN})\b"), 1), lambda a: F.struct(a.alias("a"), F.lit(None).cast("string").alias("b")))
    groups = texts.select(*keys, F.posexplode(F.concat(ranges, singles)).alias("group_no", "g"))
    (ra, ca), (rb, cb) = zone(F.col("g.a")), zone(F.col("g.b"))
    return groups.select(*keys, "group_no", ra.alias("row_a"), ca.alias("col_a"), rb.alias("row_b"), cb.alias("col_b"))


def zone_resolve(groups: DataFrame, grid: DataFrame, *keys: str) -> DataFrame:
    """(keys, page_id, group_no, x0, y0, x1, y1): the box of each group on its page's grid; groups with an unknown label go.

    ``grid``: (page_id, axis, label, centre, step, page_w, page_h), axis ``col`` or ``row``. A page's few
    labels become two maps, so that groups meet the grid in one join on the page.
    """
    entry = lambda axis: F.map_from_entries(F.collect_list(F.when(F.col("axis") == axis, F.struct("label", "centre"))))
    step = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("step")))
    pages = grid.groupBy("page_id").agg(
        entry("row").alias("row_at"), entry("col").alias("col_at"), step("row").alias("row_step"), step("col").alias("col_step"), F.max("page_w").alias("col_size"), F.max("page_h").alias("row_size")
    )
    place = lambda axis, end: F.try_element_at(f"{axis}_at", F.coalesce(f"{axis}_{end}", f"{axis}_a"))
    ends = {f"{axis}_{end}_at": place(axis, end) for axis in ("row", "col") for end in ("a", "b")}
    found = groups.join(pages, "page_id").withColumns(ends).dropna(subset=list(ends))
    low = lambda axis: F.least(*(F.greatest(F.lit(0.0), F.col(f"{axis}_{e}_at") - F.col(f"{axis}_step") / 2) for e in ("a", "b")))
    high = lambda axis: F.greatest(*(F.least(F.col(f"{axis}_size"), F.col(f"{axis}_{e}_at") + F.col(f"{axis}_step") / 2) for e in ("a", "b")))
    return found.select(*keys, "page_id", "group_no", low("col").alias("x0"), low("row").alias("y0"), high("col").alias("x1"), high("row").alias("y1"))


COLOURS = 6


def painted_regions(items: DataFrame, grid: DataFrame, *keys: str, dpi: int = 200) -> DataFrame:
    """(page_id, keys, row_no, item, status, boxes, resolved, colour) of each report item; ``items``: page_id, keys, row_no, item, zone_text, status.

    ``keys`` tell apart the reports of a page that has several.
    """
    own = [*keys, "row_no"]
    groups = zone_groups(items, "page_id", *own)
    px = lambda c: (F.col(c) * (dpi / 72.0)).cast("int")
    boxes = zone_resolve(groups, grid, *own).select("page_id", *own, F.struct("group_no", px("x0").alias("x0"), px("y0").alias("y0"), px("x1").alias("x1"), px("y1").alias("y1")).alias("box"))
    boxes = boxes.groupBy("page_id", *own).agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    joined = items.join(boxes, ["page_id", *own], "left")
    return joined.select("page_id", *own, "item", "status", "boxes", F.col("boxes").isNotNull().alias("resolved"), ((F.col("row_no") - 1) % COLOURS).alias("colour"))


def unresolved_items(regions: DataFrame) -> DataFrame:
    """(unresolved, total) over all items."""
    return regions.agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count("*").alias("total"))
