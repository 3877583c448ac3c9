"""Helpers shared by the text operators: scratch tables, batched Python tasks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.scratch import keep, keep_last
from sheetwise.tasks import ship

WORD_GAP = "[\\x20\\x09-\\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def rows_of(rows: DataFrame, chosen: DataFrame, marks: list[str]) -> DataFrame:
    """Columns of ``rows``, ``chosen`` beside, for the rows that it has by ``marks``; ``repeated`` ones come once."""
    once = rows.join(chosen.where("not repeated").drop("repeated"), marks)
    several = chosen.where("repeated").drop("repeated")
    if not several.take(1):
        return once
    # Rows that can't be told apart; partial aggregates leave one a task.
    found = rows.join(several, marks)
    one = found.groupBy(*marks).agg(F.first(F.struct(*(c for c in found.columns if c not in marks))).alias("one"))
    return once.unionByName(one.select(*marks, "one.*"))


def map_texts(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` over Arrow batches of ``df``; ``schema`` is the DDL of what it yields."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text the mask keeps. ``make`` runs once a task; the mask takes up to 512 texts."""

    def work(batches):
        mask = make()
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(mask(part.column(text).to_pylist()), pa.bool_()))

    ship(df.sparkSession)
    return df.mapInArrow(work, df.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating star contraction.

    ``edges``: two columns ``a`` and ``b`` of type long. Returns ``node`` and ``root`` (the smallest
    node of the component) for every node that has an edge to another node. Each round joins each
    edge with the smallest neighbour of its end, so no adjacency list is ever gathered; a hub is an
    ordinary skewed join key, which can be split because both sides are read from tables. Self-loops and rows with a null end are ignored; repeated edges count once.
    """
    return keep_last(lambda: _contracted(edges, max_rounds), "components")


def _contracted(edges: DataFrame, max_rounds: int) -> DataFrame:
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    e = keep(e, "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = keep(large, "edges")
        low = keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        small = (
            large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        e = keep(small, "edges")
        new = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
