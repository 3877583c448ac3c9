"""Mixing of sources to target weights by entropy balancing.

Each document gets the rate ``min(MAX_COPIES, exp(lambda * x))``, where x is its size over the mean
size of its source: the rates nearest to one in relative entropy whose expected words meet the
source's target. lambda solves the convex dual of that problem. Newton steps run for all sources at
once over the histogram of sizes by source, which is all that the sums depend on; a bracket around
the root catches steps that leave it. Sums are decimal, so that their order doesn't matter.

Rates become whole copies by systematic rounding: documents stand by source and size, their
fractional rates are summed along that order, and one gets a further copy where the sum passes the
next whole number. The words taken so differ from the expected ones by about one document's size.
Ranks are local to (source, size, bucket) cells, so a source with a third of all rows is spread.
DataFrame functions only.

Defined results: a null text has size zero; null sources form one source, which comes last; rows
that repeat each count; sources without words have the target zero and take nothing; an empty table
gives no rows; other columns are kept by ``mixed_documents`` and ignored by ``mix``. Documents of one source and size share a rate, and
the order of a hash of the id tells which get a further copy. The words of a very long text are counted in its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import free_name, keep, keep_last, rows_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
TOLERANCE = 1e-6
MAX_ROUNDS = 60
CELL = 1_000_000
BLOCK = 10_000
UNIT = 1_000_000
WORD = "[^\\x20\\x09-\\x0D]+"


def _sized(docs: DataFrame) -> DataFrame:
    """Add ``mix_key``, a name of the source that is never null and sorts as asked, and ``mix_size``."""
    return docs.withColumns(
        {
            "mix_key": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))),
            "mix_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        }
    )


def ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Number the rows of ``df`` from 0 by ``key``: a range partitioning, then a rank in each partition."""
    parts = keep(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("part").orderBy(key)
    return parts.join(starts, "part").withColumn(name, F.col("start") + F.row_number().over(here) - 1).drop("part", "start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(mix_key, source_size, target) from (mix_key, source_size).

    The total is shared by weight; a share stops at ``most`` times its source's size and the excess is
    shared anew among the others, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    table = keep(ranked(sources, "mix_key").select("mix_key", "source_size", weight.alias("weight")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # A source is capped for good once its share at some level is above its cap; levels only rise.
        capped = F.lit(False) if level is None else F.col("weight") * level > most * F.col("source_size")
        x = table.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("long"))).first()
        if not x[1]:
            break
        new = (total - x[0]) / x[1]
        if level is not None and x[2] == held:
            break
        level, held = new, x[2]
    target = F.lit(0.0) if level is None else F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return table.select("mix_key", "source_size", target.alias("target"))


def _rate(most: int) -> F.Column:
    x = F.col("mix_size") / F.col("mean")
    return F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * x)))


def solve(sizes: DataFrame, aims: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """(mix_key, source_size, target, mean, lam) from the histogram (mix_key, mix_size, n) and the targets."""
    means = sizes.groupBy("mix_key").agg((F.sum(F.col("mix_size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = aims.join(means, "mix_key").where("source_size > 0")
    state = keep(state.select("*", F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(1.0).alias("off")), "dual")
    for _ in range(MAX_ROUNDS):
        rate, words = _rate(most), F.col("n") * F.col("mix_size")
        exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
        sums = sizes.join(state.select("mix_key", "source_size", "target", "mean", "lam"), "mix_key").groupBy("mix_key").agg(
            exact(words * rate).alias("got"),
            exact(F.when(rate < most, words * rate * F.col("mix_size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high"))
        off = F.abs(F.col("got") - F.col("target")) / F.col("target")
        moved = state.join(sums, "mix_key").withColumns({"low": low, "high": high}).withColumn(
            "next", F.when(off <= TOLERANCE, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        )
        state = keep(moved.select("mix_key", "source_size", "target", "mean", F.col("next").alias("lam"), "low", "high", off.alias("off")), "dual")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual isn't solved to {TOLERANCE} after {MAX_ROUNDS} rounds")
    return state.select("mix_key", "source_size", "target", "mean", "lam")


def _copies(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add source_size, target and copies to the rows of a written table with mix_key, mix_size and doc_id."""
    sizes = keep(sized.groupBy("mix_key", "mix_size").agg(F.count("*").alias("n")), "histogram")
    aims = keep(targets(sizes.groupBy("mix_key").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size")), weights, most), "targets")
    dual = solve(sizes, aims, most)

    largest = sizes.agg(F.max("n")).first()[0] or 1
    mixed = F.xxhash64(F.col("doc_id"), F.lit("mix"))
    # Buckets follow the order of the hash, so their number doesn't change which documents get a further copy.
    bucket = F.floor((mixed / F.lit(2.0**64) + 0.5) * F.lit(-(-largest // CELL)))
    rates = sizes.join(aims, "mix_key").join(dual.select("mix_key", "mean", "lam"), "mix_key", "left").select(
        "mix_key", "mix_size", "source_size", "target", F.when(F.col("source_size") > 0, F.round(_rate(most) * UNIT)).otherwise(0).cast("long").alias("rate")
    )
    cells = sized.groupBy("mix_key", "mix_size", bucket.alias("mix_bucket")).agg(F.count("*").alias("n")).join(rates, ["mix_key", "mix_size"])
    before = Window.partitionBy("mix_key").orderBy("mix_size", "mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("rate") % UNIT
    cells = cells.withColumn("start", F.coalesce(F.sum(part * F.col("n")).over(before), F.lit(0)) + UNIT // 2).drop("n")

    here = Window.partitionBy("mix_key", "mix_size", "mix_bucket").orderBy(mixed, "doc_id")
    rows = sized.withColumn("mix_bucket", bucket).join(cells, ["mix_key", "mix_size", "mix_bucket"]).withColumn("nth", F.row_number().over(here))
    passed = lambda n: F.floor((F.col("start") + n * part) / UNIT)
    return rows.withColumn("copies", F.floor(F.col("rate") / UNIT) + passed(F.col("nth")) - passed(F.col("nth") - 1)).drop("mix_key", "mix_bucket", "start", "rate", "nth")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of ``docs``."""

    def make():
        sized = keep(_sized(docs.select("doc_id", "text", "source")).select("doc_id", "mix_key", "mix_size"), "sized")
        return _copies(sized, weights, most)

    return keep_last(make, "mixed").select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mix_size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The columns of ``docs`` and ``copy_no``: each document as often as the mix takes it, rows that repeat numbered on.

    Ids and sizes alone are ranked; copies come back to rows by two hashes of the row's columns but for maps, and texts move once.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    names = [free_name(docs, c) for c in ("mix_hash", "mix_mark")]
    marks = dict(zip(names, (F.xxhash64(*plain), F.xxhash64(*(x for c in plain for x in (F.col(c).isNull(), F.col(c)))))))

    def make():
        sized = keep(_sized(docs.select("doc_id", "text", "source", *(m.alias(c) for c, m in marks.items()))).select("doc_id", *names, "mix_key", "mix_size"), "sized")
        return _copies(sized, weights, most).groupBy(*names).agg(F.sum("copies").alias("copies"), (F.count("*") > 1).alias("repeated")).where("copies > 0")

    taken = keep_last(make, "copies")
    count, block, copy_no = (free_name(docs, c) for c in ("copies", "copies_block", "copy_no"))
    rows = rows_of(docs.withColumns(marks), taken.withColumnRenamed("copies", count), names)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    blocks = rows.withColumn(block, F.explode(upto(F.ceil(F.col(count) / BLOCK))))
    out = blocks.select(*docs.columns, block, F.explode(upto(F.least(F.lit(BLOCK).cast("long"), F.col(count) - F.col(block) * BLOCK))).alias(copy_no))
    return out.select(*docs.columns, (F.col(block) * BLOCK + F.col(copy_no) + 1).alias(copy_no))
