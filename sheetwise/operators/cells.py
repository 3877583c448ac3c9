"""Symbols of cells: scores against templates, rankings, tables, and matches outside all cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G

REPRESENTATIONS = ("gray", "binary", "edges")
PRIMARY = "gray"
MIN_SCORE, MIN_MARGIN = 0.55, 0.12
COVERAGE_MARGIN = 3.0
INSET, MIN_INSET, MAX_INSET = 0.05, 0.6, 3.0
CROP_PADDING = 4.0
#: Templates go to every task only up to this number; more are dealt over decks.
MAX_BROADCAST = 2000


def _unit(df: DataFrame) -> DataFrame:
    """Replace ``vec`` by its deviation from its mean over its norm; a flat vector becomes zero."""
    t = df.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    t = t.withColumn("mean", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / F.size("vec"))
    t = t.withColumn("vec", F.transform("vec", lambda x: x - F.col("mean")))
    t = t.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    return t.withColumn("vec", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0)))).drop("mean", "norm")


def template_correlation(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """(cell_id, representation, template, score): zero-mean normalised correlation of equal-sized vectors.

    ``cells``: (cell_id, representation, vec); ``templates``: (template, representation, vec). Up to MAX_BROADCAST templates go to
    every task. More are dealt over decks of about as many, and a cell visits each deck of its representation.
    """
    t = _unit(templates).select("template", "representation", F.col("vec").alias("tvec"))
    n = templates.count()
    own = _unit(cells)
    if n <= MAX_BROADCAST:
        both = own.join(F.broadcast(t), "representation")
    else:
        decks = -(-n // MAX_BROADCAST)
        dealt = t.withColumn("deck", F.pmod(F.xxhash64("template"), F.lit(decks)))
        # A part of the cells' hash is a key too, so that a deck's cells aren't one task's.
        parts = 8 * decks
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        spread = own.withColumn("deck", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(decks - 1).cast("long")))).withColumn("part", F.pmod(F.xxhash64("cell_id"), F.lit(parts)))
        both = spread.join(dealt, ["representation", "deck", "part"])
    score = F.aggregate(F.zip_with("vec", "tvec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return both.select("cell_id", "representation", "template", score.alias("score"))


def cell_ranking(scores: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN, table: bool = False) -> DataFrame:
    """(cell_id, best, best_score, second, second_score, margin, agreement, accepted) by the primary representation.

    The margin of a cell with one template is its score. Agreement: all representations have the same best template.
    Only the two best of a cell and representation pass: each task keeps two rows of what it has read, before and behind the shuffle.
    With ``table``, best and rounded score of each representation too.
    """
    order = Window.partitionBy("cell_id", "representation").orderBy(F.desc("score"), "template")
    two = scores.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    entry = lambda k, r: F.max(F.when((F.col("nth") == k) & (F.col("representation") == r), F.struct("template", "score")))
    top = F.when(F.col("nth") == 1, F.col("template"))
    wide = two.groupBy("cell_id").agg(entry(2, PRIMARY).alias("two"), *(entry(1, r).alias(f"top_{r}") for r in REPRESENTATIONS), (F.min(top) == F.max(top)).alias("same"))
    return _verdict(wide, ["cell_id"], F.col("same"), min_score, min_margin, table)


def _verdict(wide: DataFrame, keys: list[str], same: Column, min_score: float, min_margin: float, table: bool) -> DataFrame:
    """``keys`` and the columns of ``cell_ranking``, of the best (template, score) of each representation, ``top_*``, and the primary's second, ``two``."""
    one = f"top_{PRIMARY}"
    margin = F.coalesce(F.col(f"{one}.score") - F.col("two.score"), F.col(f"{one}.score"), F.lit(0.0))
    beside = [c for r in REPRESENTATIONS for c in (F.col(f"top_{r}.template").alias(f"{r}_best"), F.round(f"top_{r}.score", 4).alias(f"{r}_score"))] if table else []
    t = wide.select(
        *keys, F.col(f"{one}.template").alias("best"), F.col(f"{one}.score").alias("best_score"), F.col("two.template").alias("second"), F.col("two.score").alias("second_score"), margin.alias("margin"), F.coalesce(same, F.lit(False)).alias("agreement"), *beside
    )
    return t.withColumn("accepted", F.coalesce((F.col("best_score") >= min_score) & (F.col("margin") >= min_margin), F.lit(False)))


def entry(template: Column, score: Column) -> Column:
    """A template's score in the list of a cell. Lists sort by falling score (NaN first, null last), then template, as the rows of ``cell_ranking`` do."""
    return F.struct(score.isNull().alias("missing"), (~F.isnan(score)).alias("number"), (-score).alias("fall"), template.alias("template"), score.alias("score"))


def ranked_on_row(cells: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN, table: bool = False) -> DataFrame:
    """``cells`` with the columns of ``cell_ranking`` in place of its lists of scores: a cell is ranked on its own row, nothing is shuffled or sorted.

    A list of ``entry`` for each representation, as ``scores_gray``, with all templates. A cell without a score has nulls and isn't accepted.
    """
    lists = {r: f"scores_{r}" for r in REPRESENTATIONS}
    keys = [c for c in cells.columns if c not in lists.values()]
    t = cells.withColumn(lists[PRIMARY], F.sort_array(lists[PRIMARY]))
    top = lambda r: F.get(lists[r], F.lit(0)) if r == PRIMARY else F.array_min(lists[r])
    t = t.select(*keys, F.get(lists[PRIMARY], F.lit(1)).alias("two"), *(top(r).alias(f"top_{r}") for r in REPRESENTATIONS))
    tops = [F.col(f"top_{r}.template") for r in REPRESENTATIONS]
    return _verdict(t, keys, F.least(*tops) == F.greatest(*tops), min_score, min_margin, table)


def representation_table(scores: DataFrame) -> DataFrame:
    """(cell_id, best and score for each representation, agreement, accepted)."""
    table = [f"{r}_{c}" for r in REPRESENTATIONS for c in ("best", "score")]
    return cell_ranking(scores, table=True).select("cell_id", *table, "agreement", "accepted")


def class_counts(ranking: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, n): accepted cells of each template, zeros included."""
    n = ranking.where("accepted").groupBy(F.col("best").alias("template")).agg(F.count("*").alias("n"))
    return templates.select("template").distinct().join(n, "template", "left").select("template", F.coalesce("n", F.lit(0)).alias("n"))


def classified_order(ranking: DataFrame) -> DataFrame:
    """Cells in the order of the contact sheet: accepted first, then by class, then by falling score."""
    label = F.when(F.col("accepted"), F.col("best")).otherwise("")
    return ranking.select("cell_id", "accepted", label.alias("label"), "best_score").orderBy(F.desc("accepted"), "label", F.desc("best_score"), "cell_id")


def gdt_first_cell(cells: DataFrame) -> DataFrame:
    """(cell_id, best, best_score, verdict) of first cells, their scores on their row; with one template the margin is the score."""
    ranked = ranked_on_row(cells.where("is_first"))
    return ranked.select("cell_id", "best", "best_score", F.when(F.col("accepted"), "validated").otherwise("rejected").alias("verdict"))


def uncovered_matches(matches: DataFrame, cells: DataFrame, margin: float = COVERAGE_MARGIN) -> DataFrame:
    """(page_id, symbol, score, scale, x0, y0, x1, y1) of matches whose centre lies in no cell grown by the margin.

    Matches and cells share one unit; page and square are the equi-keys of the anti-join. Cells are sorted, not sent to the driver and every
    task: their table may be far smaller on disk than its rows are.
    """
    low = lambda c: F.col(c) - margin
    high = lambda c: F.col(c) + margin
    c = G.in_squares(cells.select("page_id", "x0", "y0", "x1", "y1"), low("x0"), low("y0"), high("x1"), high("y1"))
    c = c.select(F.col("page_id").alias("cell_page"), "sx", "sy", low("x0").alias("cx0"), low("y0").alias("cy0"), high("x1").alias("cx1"), high("y1").alias("cy1"))
    m = matches.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    here = (F.col("page_id") == F.col("cell_page")) & (G.square_of(F.col("mx")) == F.col("sx")) & (G.square_of(F.col("my")) == F.col("sy"))
    inside = here & F.col("mx").between(F.col("cx0"), F.col("cx1")) & F.col("my").between(F.col("cy0"), F.col("cy1"))
    return m.join(c.hint("merge"), inside, "left_anti").select("page_id", "symbol", F.round("score", 4).alias("score"), "scale", *(F.round(k, 2).alias(k) for k in ("x0", "y0", "x1", "y1")))


def cell_inset(boxes: DataFrame, zoom: float, page_w: int, page_h: int) -> DataFrame:
    """Add px0, py0, px1, py1: the inside of each box in pixels, within the page; null under 3 pixels."""
    inset = lambda a, b: F.greatest(F.lit(MIN_INSET), F.least(F.lit(MAX_INSET), F.abs(F.col(b) - F.col(a)) * INSET))
    px = {
        "px0": F.greatest(F.lit(0), F.bround((F.col("x0") + inset("x0", "x1")) * zoom).cast("int")),
        "py0": F.greatest(F.lit(0), F.bround((F.col("y0") + inset("y0", "y1")) * zoom).cast("int")),
        "px1": F.least(F.lit(page_w), F.bround((F.col("x1") - inset("x0", "x1")) * zoom).cast("int")),
        "py1": F.least(F.lit(page_h), F.bround((F.col("y1") - inset("y0", "y1")) * zoom).cast("int")),
    }
    t = boxes.withColumns(px)
    small = (F.col("px1") - F.col("px0") < 3) | (F.col("py1") - F.col("py0") < 3)
    return t.select(*boxes.columns, *(F.when(~small, F.col(c)).alias(c) for c in px))


def crop_box(boxes: DataFrame, zoom: float, page_w: int, page_h: int) -> DataFrame:
    """Add px0, py0, px1, py1: each box padded by 4 points, in pixels, within the page; null if nothing is left."""
    px = {
        "px0": F.greatest(F.lit(0), F.bround((F.col("x0") - CROP_PADDING) * zoom).cast("int")),
        "py0": F.greatest(F.lit(0), F.bround((F.col("y0") - CROP_PADDING) * zoom).cast("int")),
        "px1": F.least(F.lit(page_w), F.bround((F.col("x1") + CROP_PADDING) * zoom).cast("int")),
        "py1": F.least(F.lit(page_h), F.bround((F.col("y1") + CROP_PADDING) * zoom).cast("int")),
    }
    t = boxes.withColumns(px)
    empty = (F.col("px1") <= F.col("px0")) | (F.col("py1") <= F.col("py0"))
    return t.select(*boxes.columns, *(F.when(~empty, F.col(c)).alias(c) for c in px))
