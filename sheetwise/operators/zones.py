"""Zone grids from the labels at the edges of a sheet, and the zones of dimensions."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import text as T
from sheetwise.tasks import ship

EDGE = 0.13
STEP_TOLERANCE = 0.06
MIN_LABELS = 3
MARGIN = 0.08
# Fixed value: the form of a dimension text.
DIMENSION = r"^\(?\d+[.,]\d*(?:[±+-]\d+[.,]\d+)?\)?$"


def grid_labels(spans: DataFrame) -> DataFrame:
    """(page_id, axis, label, coord, page_w, page_h): short labels near the edges; a span may count for one axis."""
    text = T.strip("text")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = lambda v, size: (v < F.col(size) * EDGE) | (v > F.col(size) * (1 - EDGE))
    column = near(cy, "page_h") & text.rlike(r"^\d{1,2}$")
    row = near(cx, "page_w") & text.rlike(r"^\p{L}{1,2}$")
    return spans.where(column | row).select(
        "page_id", F.when(column, "col").otherwise("row").alias("axis"), F.when(column, text).otherwise(F.upper(text)).alias("label"), F.when(column, cx).otherwise(cy).alias("coord"), "page_w", "page_h"
    )


def longest_chain(coords: list[float], labels: list[str]) -> list[int]:
    """Places of the longest regularly spaced chain in the sorted ``coords``; empty without a pair more than 1 apart.

    A seed is a pair of labels more than 1 apart. The chain grows by the first unused label within 6 % of a step from the next
    place, looked up by binary search. The longest chain wins, of equals that of the first seed; a seed whose step leaves no
    room for a longer chain isn't followed.
    """
    n, best = len(coords), []
    for i in range(n):
        for j in range(i + 1, n):
            step, at = coords[j] - coords[i], coords[j]
            if step <= 1.0 or len(best) >= 2 + (coords[-1] - at) / (step * (1 - STEP_TOLERANCE)) + 1e-9:
                continue
            chain, used, slack, k = [i, j], {labels[i], labels[j]}, step * STEP_TOLERANCE, j + 1
            while True:
                k = bisect_left(coords, at + step - slack - 1e-6, k)  # a little early; the exact test follows
                while k < n and coords[k] <= at + step + slack + 1e-6 and not (abs(coords[k] - (at + step)) <= slack and labels[k] not in used):
                    k += 1
                if k == n or coords[k] > at + step + slack + 1e-6:
                    break
                chain.append(k)
                used.add(labels[k])
                at, k = coords[k], k + 1
            if len(chain) > len(best):
                best = chain
    return best


def _chains(batches):
    point = pa.struct([("coord", pa.float64()), ("label", pa.string())])
    for batch in batches:
        chains, steps = [], []
        for pts in batch.column("pts").to_pylist():
            chain = [pts[k] for k in longest_chain([p["coord"] for p in pts], [p["label"] for p in pts])]
            chains.append(chain)
            steps.append(chain[1]["coord"] - chain[0]["coord"] if chain else None)
        columns = [batch.column("page_id"), batch.column("axis"), pa.array(chains, pa.list_(point)), pa.array(steps, pa.float64()), batch.column("page_w"), batch.column("page_h")]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "axis", "chain", "step", "page_w", "page_h"])


def progressions(labels: DataFrame) -> DataFrame:
    """(page_id, axis, chain, step, page_w, page_h): the longest regularly spaced chain of labels on each axis that has one.

    Labels of an axis are ordered by coordinate, to one decimal, and label, each once.
    """
    point = F.struct(F.bround("coord", 1).cast("double").alias("coord"), F.col("label").cast("string").alias("label"))
    size = lambda c: F.max(F.col(c).cast("double")).alias(c)
    listed = labels.groupBy("page_id", "axis").agg(F.array_sort(F.collect_set(point)).alias("pts"), size("page_w"), size("page_h"))
    ship(labels.sparkSession)
    page = labels.schema["page_id"].dataType.simpleString()
    found = listed.mapInArrow(_chains, f"page_id {page}, axis string, chain array<struct<coord: double, label: string>>, step double, page_w double, page_h double")
    return found.where(F.size("chain") > 0)


def grid(spans: DataFrame) -> DataFrame:
    """(page_id, axis, label, centre, step, page_w, page_h) of pages with three or more labels on both axes.

    A label that stands twice in a chain keeps its last place.
    """
    chains = progressions(grid_labels(spans))
    labels = F.array_distinct(F.transform("chain", lambda p: p["label"]))
    axis = F.struct("axis", "step", "chain", labels.alias("labels"))
    pages = chains.groupBy("page_id").agg(F.collect_list(axis).alias("axes"), F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    enough = lambda name: F.exists("axes", lambda a: (a["axis"] == name) & (F.size(a["labels"]) >= MIN_LABELS))
    one = pages.where(enough("col") & enough("row")).select("page_id", "page_w", "page_h", F.explode("axes").alias("a"))
    marks = one.select("page_id", "page_w", "page_h", "a.axis", "a.step", "a.chain", F.explode("a.labels").alias("label"))
    centre = F.element_at(F.filter("chain", lambda p: p["label"] == F.col("label")), -1)["coord"]
    return marks.select("page_id", "axis", "label", centre.alias("centre"), "step", "page_w", "page_h")


def zone_marker_spans(spans: DataFrame) -> DataFrame:
    """(page_id, kind, text, cx, cy): row letters, column numbers and dimensions; the first rule that fits wins."""
    text = F.upper(T.strip("text"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    outer = lambda v, size: (v < F.col(size) * MARGIN) | (v > F.col(size) * (1 - MARGIN))
    kind = (
        F.when(text.rlike("^[A-H]$") & outer(cx, "page_w"), "row")
        .when(text.rlike("^(?:[1-9]|1[0-5])$") & outer(cy, "page_h"), "col")
        .when(text.rlike(DIMENSION), "dimension")
    )
    return spans.select("page_id", kind.alias("kind"), text.alias("text"), cx.alias("cx"), cy.alias("cy")).where("kind is not null")


def zone_markers_median(markers: DataFrame) -> DataFrame:
    """(page_id, axis, label, centre): the median place of each marker."""
    at = F.when(F.col("kind") == "row", F.col("cy")).otherwise(F.col("cx"))
    return markers.where("kind <> 'dimension'").groupBy("page_id", F.col("kind").alias("axis"), F.col("text").alias("label")).agg(F.median(at).alias("centre"))


def zone_limits(centres: DataFrame) -> DataFrame:
    """(page_id, axis, label, start, end): each zone ends half way to the next marker, the last nowhere."""
    here = Window.partitionBy("page_id", "axis").orderBy("centre", "label")
    half = (F.col("centre") + F.lead("centre").over(here)) / 2
    t = centres.withColumn("end", F.coalesce(half, F.lit(float("inf"))))
    return t.select("page_id", "axis", "label", F.coalesce(F.lag("end").over(here), F.lit(float("-inf"))).alias("start"), "end")


def dimension_zone(markers: DataFrame, limits: DataFrame) -> DataFrame:
    """(page_id, text, cx, cy, zone): row and column of each dimension; ? for an axis without markers.

    Zones have the equi-key page, and start < place <= end picks one of a page's few zones.
    """
    out = markers.where("kind = 'dimension'").select("page_id", "text", "cx", "cy")
    for axis, at in (("row", "cy"), ("col", "cx")):
        side = limits.where(F.col("axis") == axis).select(F.col("page_id").alias("zone_page"), F.col("label").alias(axis), F.col("start").alias(f"{axis}_start"), F.col("end").alias(f"{axis}_end"))
        match = (F.col("page_id") == F.col("zone_page")) & (F.col(at) > F.col(f"{axis}_start")) & (F.col(at) <= F.col(f"{axis}_end"))
        out = out.join(side, match, "left").drop("zone_page", f"{axis}_start", f"{axis}_end")
    return out.select("page_id", "text", "cx", "cy", F.concat(F.coalesce("row", F.lit("?")), F.coalesce("col", F.lit("?"))).alias("zone"))


def located_dimensions(spans: DataFrame) -> DataFrame:
    markers = zone_marker_spans(spans)
    return dimension_zone(markers, zone_limits(zone_markers_median(markers)))
