"""Tolerance frames rebuilt from loose strokes, their cells, words, numbers and confidence.

Geometry is in points. Lines, words and cells meet by page and square of a grid on it, so what is compared
with a box doesn't grow with the page. Greedy steps fold over groups of frames that a sweep across the page can't part,
since only frames that touch can drop each other. Strokes of all pages are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.functions import text as T

LINE, BORDER, MERGE_GAP, ENDPOINT = 1.0, 30.0, 2.0, 4.5
MIN_HEIGHT, MAX_HEIGHT, MIN_WIDTH, MAX_WIDTH = 5.0, 40.0, 15.0, 300.0
MIN_CELLS, MAX_CELLS, MIN_CELL = 2, 6, 4.0
MIN_ASPECT, MAX_ASPECT = 0.5, 2.5
SLACK, MAX_IOU, MAX_CONTAINED = 0.5, 0.5, 0.9
SNAP = 0.5

#: Parts for each core, at least, of what is dealt by page: a page's rows are few bytes in a shuffle and many cells behind it, so parts aren't merged by their bytes.
DEALT = 4


def _dealt(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), DEALT * spark.sparkContext.defaultParallelism), "page_id")


def segment_classify(strokes: DataFrame) -> DataFrame:
    """(page_id, axis, at, lo, hi): h strokes at their mean y, v strokes at their mean x, without the page border.

    A stroke flat in both directions counts as h. Diagonals and strokes without length go.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    flat = dy <= LINE
    pick = lambda h, v: F.when(flat, h).otherwise(v)
    t = strokes.where(flat | (dx <= LINE)).select(
        "page_id",
        pick(F.lit("h"), F.lit("v")).alias("axis"),
        pick((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2).alias("at"),
        pick(F.least("x0", "x1"), F.least("y0", "y1")).alias("lo"),
        pick(F.greatest("x0", "x1"), F.greatest("y0", "y1")).alias("hi"),
        pick(F.col("page_h"), F.col("page_w")).alias("size"),
    )
    return t.where((F.col("at") >= BORDER) & (F.col("at") <= F.col("size") - BORDER) & (F.col("hi") > F.col("lo"))).drop("size")


def merge_segments(segments: DataFrame, axis: str) -> DataFrame:
    """(page_id, at, lo, hi): collinear neighbours joined; two rounds of gaps and islands.

    A row of segments continues while the gap to the previous one is at most 1; within it, segments
    join while the next begins at most 2 behind the running end. All take the mean of the whole row.
    """
    rows = Window.partitionBy("page_id").orderBy("at", "lo", "hi")
    t = segments.where(F.col("axis") == axis).withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(rows), F.lit(1e9)) > LINE).cast("int"))
    t = t.withColumn("line", F.sum("new").over(rows))
    along = Window.partitionBy("page_id", "line").orderBy("lo", "hi")
    end = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    mean = F.avg("at").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumns({"new": F.coalesce(F.col("lo") > end + MERGE_GAP, F.lit(True)).cast("int"), "at": mean})
    t = t.withColumn("piece", F.sum("new").over(along))
    return t.groupBy("page_id", "line", "piece").agg(F.min("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("page_id", "at", "lo", "hi")


def line_pairs(h: DataFrame) -> DataFrame:
    """(page_id, top_id, bottom_id, top, bottom, left, right): pairs of h lines as far apart as a frame is high, with what they have in common.

    A window by height brings each line those below it, so a page's lines aren't all paired, and lines are made and sorted once, without a join.
    Line ids keep equal pairs apart. The window reaches a point further than a frame may; the exact bounds follow.
    """
    page = Window.partitionBy("page_id")
    lines = h.withColumn("line_id", F.row_number().over(page.orderBy("at", "lo", "hi")))
    line = F.struct(F.col("line_id").alias("bottom_id"), F.col("at").alias("bottom"), F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    below = F.collect_list(line).over(page.orderBy("at").rangeBetween(int(MIN_HEIGHT) - 1, int(MAX_HEIGHT) + 1))
    pairs = lines.withColumn("below", below).select("page_id", F.col("line_id").alias("top_id"), F.col("at").alias("top"), F.col("lo").alias("a0"), F.col("hi").alias("a1"), F.inline("below"))
    gap = F.col("bottom") - F.col("top")
    pairs = pairs.where((F.col("bottom_id") > F.col("top_id")) & (gap >= MIN_HEIGHT) & (gap <= MAX_HEIGHT))
    return pairs.select("page_id", "top_id", "bottom_id", "top", "bottom", F.greatest("a0", "b0").alias("left"), F.least("a1", "b1").alias("right")).where(F.col("right") - F.col("left") >= MIN_WIDTH)


def frame_connectors(h: DataFrame, v: DataFrame) -> DataFrame:
    """(page_id, top_id, bottom_id, top, bottom, left, right, xs): pairs of h lines and the sorted places of the v lines that join them.

    What squares have found is dealt by page, once for the lists and for all that follows by page.
    """
    keys = ["page_id", "top_id", "bottom_id", "top", "bottom", "left", "right"]
    found = _dealt(line_crossings(line_pairs(h), v).select(*keys, "x")).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return found.where(F.size("xs") >= MIN_CELLS + 1)


def line_candidates(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """``pairs`` with the v lines (x, v0, v1) of their squares: the pair takes the squares along its top, the line those along its length."""
    x = v.select("page_id", F.col("at").alias("x"), F.col("lo").alias("v0"), F.col("hi").alias("v1"), G.square_of(F.col("at")).alias("sx"))
    x = x.withColumn("sy", F.explode(G.squares_between(F.col("v0") - ENDPOINT, F.col("v1") + ENDPOINT)))
    own = pairs.withColumn("sx", F.explode(G.squares_between(F.col("left") - ENDPOINT, F.col("right") + ENDPOINT))).withColumn("sy", G.square_of(F.col("top")))
    return own.join(x, ["page_id", "sx", "sy"]).drop("sx", "sy")


def line_crossings(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """``pairs`` with each v line that reaches from the top line to the bottom line between their ends."""
    return line_candidates(pairs, v).where(
        (F.col("x") >= F.col("left") - ENDPOINT) & (F.col("x") <= F.col("right") + ENDPOINT) & (F.col("v0") <= F.col("top") + ENDPOINT) & (F.col("v1") >= F.col("bottom") - ENDPOINT)
    )


def spaced(xs):
    """Places at least MIN_CELL from the last one kept; a lag isn't enough, since dropped ones don't count."""
    return F.aggregate(xs, F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= MIN_CELL), F.array_append(kept, x)).otherwise(kept))


def connector_spacing(found: DataFrame) -> DataFrame:
    t = found.withColumn("xs", spaced(F.col("xs")))
    return t.where(F.size("xs").isin(*range(MIN_CELLS + 1, MAX_CELLS + 2)))


def frame_cells(found: DataFrame) -> DataFrame:
    """(page_id, ord, x0, y0, x1, y1, n_cells, cells): frames in order of their lines; cells lie between neighbouring connectors."""
    n = F.size("xs") - 1
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda k: G.box(F.get("xs", k), F.col("top"), F.get("xs", k + 1), F.col("bottom")))
    order = Window.partitionBy("page_id").orderBy("top_id", "bottom_id")
    return found.select(
        "page_id", F.row_number().over(order).cast("long").alias("ord"), F.get("xs", F.lit(0)).alias("x0"), F.col("top").alias("y0"), F.get("xs", n).alias("x1"), F.col("bottom").alias("y1"), n.alias("n_cells"), cells.alias("cells")
    )


def raw_frames(strokes: DataFrame) -> DataFrame:
    segments = segment_classify(strokes)
    return frame_cells(connector_spacing(frame_connectors(merge_segments(segments, "h"), merge_segments(segments, "v"))))


def frame_filter(frames: DataFrame) -> DataFrame:
    """Frames of plausible height, width, number of cells and first-cell aspect."""
    first = F.get("cells", F.lit(0))
    aspect = G.width(first) / F.greatest(G.height(first), F.lit(1e-6))
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    return frames.where(h.between(MIN_HEIGHT, MAX_HEIGHT) & w.between(MIN_WIDTH, MAX_WIDTH) & F.col("n_cells").between(MIN_CELLS, MAX_CELLS) & aspect.between(MIN_ASPECT, MAX_ASPECT))


def frame_signature_dedup(frames: DataFrame) -> DataFrame:
    """The first frame of each page with the same corners, to one decimal, and number of cells."""
    corners = [F.bround(c, 1) for c in ("x0", "y0", "x1", "y1")]
    here = Window.partitionBy("page_id", *corners, "n_cells").orderBy("ord")
    return frames.withColumn("nth", F.row_number().over(here)).where("nth = 1").drop("nth")


def _area(f):
    return F.abs(f["x1"] - f["x0"]) * F.abs(f["y1"] - f["y0"])


def _grouped(frames: DataFrame) -> DataFrame:
    """Add ``gx`` and ``gy``: groups of a page's frames between which a sweep over x, then over y, finds a gap wider than SLACK."""
    out = frames
    for group, low, high in (("gx", "x0", "x1"), ("gy", "y0", "y1")):
        known = ["page_id", *(["gx"] if group == "gy" else [])]
        order = Window.partitionBy(*known).orderBy(F.least(low, high), "ord")
        reached = F.max(F.greatest(low, high)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("new", F.coalesce((F.least(low, high) > reached + SLACK).cast("int"), F.lit(0))).withColumn(group, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return out


def _thinned(frames: DataFrame, *steps) -> DataFrame:
    """Frames that stay after each of ``steps`` (rank, drops): in order of rank, one stays unless ``drops`` it for one that stays.

    The steps run one after the other inside a group of ``_grouped``. Order numbers are made anew by (y0, x0, ord).
    """
    whole = F.struct(*frames.columns)
    listed = _grouped(frames).groupBy("page_id", "gx", "gy").agg(F.collect_list(whole).alias("fs"))
    start = F.array().cast(f"array<{frames.select(whole.alias('f')).schema['f'].dataType.simpleString()}>")
    kept = F.col("fs")
    for rank, drops in steps:
        ordered = F.transform(F.array_sort(F.transform(kept, lambda f: F.struct(*(r.alias(f"rank{k}") for k, r in enumerate(rank(f))), f.alias("f")))), lambda x: x["f"])  # noqa: B023
        kept = F.aggregate(ordered, start, lambda acc, f: F.when(F.exists(acc, lambda k: drops(f, k)), acc).otherwise(F.array_append(acc, f)))  # noqa: B023
    out = listed.select(F.explode(F.when(F.size("fs") == 1, F.col("fs")).otherwise(kept)).alias("f")).select("f.*")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "ord")).cast("long"))


def _nested_in(f, k):
    return (k["x0"] - SLACK <= f["x0"]) & (k["y0"] - SLACK <= f["y0"]) & (f["x1"] <= k["x1"] + SLACK) & (f["y1"] <= k["y1"] + SLACK)


def _overlaps(f, k):
    common = G.intersection(f, k)
    return (common > 0) & ((common / (_area(f) + _area(k) - common) >= MAX_IOU) | (common / F.least(_area(f), _area(k)) >= MAX_CONTAINED))


#: Larger frames first; more cells first, then larger ones. The ties of the second step fall in the order that the first leaves.
_NESTED = (lambda f: (-_area(f), f["ord"]), _nested_in)
_NMS = (lambda f: (-f["n_cells"], -_area(f), f["ord"]), _overlaps)
_NMS_AFTER = (lambda f: (-f["n_cells"], -_area(f), f["y0"], f["x0"], f["ord"]), _overlaps)


def frame_nested(frames: DataFrame) -> DataFrame:
    """Drop frames that lie, with half a point of slack, in a larger frame that stays."""
    return _thinned(frames, _NESTED)


def frame_nms(frames: DataFrame) -> DataFrame:
    """Drop frames that overlap one that stays by half of their union, or by 0.9 of the smaller; more cells, then larger area, go first."""
    return _thinned(frames, _NMS)


def frame_survivors(frames: DataFrame) -> DataFrame:
    """``frame_nms`` of ``frame_nested``, in one pass over the groups."""
    return _thinned(frames, _NESTED, _NMS_AFTER)


def frame_ids(frames: DataFrame, page: Column) -> DataFrame:
    """Add frame_id by the order in the page; ``page`` is the page's number in its document, from 1."""
    return frames.withColumn("frame_id", F.format_string("GDT-CAND-P%02d-%03d", page, F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))))


def cells_of(frames: DataFrame) -> DataFrame:
    """(page_id, ord, cell_no, x0, y0, x1, y1): a row for each cell."""
    return frames.select("page_id", "ord", F.posexplode("cells").alias("cell_no", "c")).select("page_id", "ord", "cell_no", "c.*")


def _placed(words: DataFrame) -> DataFrame:
    """(page_id, word_no, wx, wy, word, sx, sy): words that aren't empty, at their centres, with the square of each."""
    w = words.where(T.strip("text") != "").select("page_id", F.col("ord").alias("word_no"), ((F.col("x0") + F.col("x1")) / 2).alias("wx"), ((F.col("y0") + F.col("y1")) / 2).alias("wy"), T.strip("text").alias("word"))
    return w.withColumns({"sx": G.square_of(F.col("wx")), "sy": G.square_of(F.col("wy"))})


def word_candidates(cells: DataFrame, words: DataFrame) -> DataFrame:
    """``cells`` with the words (word_no, wx, wy, word) of the squares that they touch."""
    return G.in_squares(cells, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).join(_placed(words), ["page_id", "sx", "sy"]).drop("sx", "sy")


def _held() -> Column:
    return (F.col("wx") >= F.col("x0")) & (F.col("wx") <= F.col("x1")) & (F.col("wy") >= F.col("y0")) & (F.col("wy") <= F.col("y1"))


def words_in_cell(cells: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """(page_id, keys, texts): words whose centre lies in the cell, edges included, in word order; empty words go."""
    hit = word_candidates(cells, words).where(_held())
    return hit.groupBy("page_id", *keys).agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("ws")).select("page_id", *keys, F.transform("ws", lambda x: x["word"]).alias("texts"))


def frame_texts(frames: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``texts``, the list of word lists of the frame's cells.

    Frames are computed once: they go along with their cells to the squares and come back with what was found there.
    """
    own = F.struct(*frames.columns)
    cells = frames.select("page_id", "ord", own.alias("f"), F.posexplode("cells").alias("cell_no", "c")).select("page_id", "ord", "f", "cell_no", "c.*")
    placed = _placed(words).withColumnRenamed("page_id", "word_page").withColumnsRenamed({"sx": "word_sx", "sy": "word_sy"})
    at = (F.col("page_id") == F.col("word_page")) & (F.col("sx") == F.col("word_sx")) & (F.col("sy") == F.col("word_sy"))
    spread = G.in_squares(cells, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    found = spread.join(placed, at & _held(), "left").groupBy("page_id", "ord").agg(F.first("f").alias("f"), F.array_sort(F.collect_list(F.when(F.col("word_no").isNotNull(), F.struct("cell_no", "word_no", "word")))).alias("ws"))
    of_cell = lambda k: F.transform(F.filter("ws", lambda w: w["cell_no"] == k), lambda w: w["word"])
    texts = F.transform(F.sequence(F.lit(0), F.size("f.cells") - 1), of_cell)
    return found.withColumn("texts", texts).select(*(F.col(f"f.{c}").alias(c) for c in frames.columns), "texts")


def _behind_first(lists):
    return F.slice(lists, F.lit(2), F.size(lists))


def frame_values(frames: DataFrame) -> DataFrame:
    """Add ``tolerances`` (texts with a number of two digits or more) and ``datums`` (single capitals) of the cells behind the first."""
    texts = F.flatten(_behind_first(F.col("texts")))
    return frames.withColumns({"tolerances": F.filter(texts, lambda t: t.rlike(r"\d+[.,]?\d+")), "datums": F.filter(texts, lambda t: t.rlike("^[A-Z]$"))})


def frame_confidence(frames: DataFrame) -> DataFrame:
    """Add ``confidence``: 0.5, and more for 3 or 4 cells, a number, and a single capital behind the first cell."""
    rest = _behind_first(F.col("texts"))
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = 0.5 + plus(F.col("n_cells").between(3, 4), 0.15) + plus(F.exists(rest, T.has_number), 0.25) + plus(F.exists(rest, T.has_letter), 0.10)
    return frames.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 2))


def gdt_frames(strokes: DataFrame, words: DataFrame, page: Column) -> DataFrame:
    """Numbered frame candidates with their words, values and confidence."""
    frames = frame_survivors(frame_signature_dedup(frame_filter(raw_frames(strokes))))
    return frame_ids(frame_values(frame_confidence(frame_texts(frames, words))), page)


def unique_cells(frames: DataFrame, page: Column) -> DataFrame:
    """(page_id, cell_id, x0, y0, x1, y1, cell_index, n_cells, is_first) of unfiltered frames: the first cell at each place, snapped to half points.

    ``page`` is the page's number in its document, from 1; with the order in the page it makes the id.
    """
    cells = frames.select("page_id", "ord", "n_cells", F.posexplode("cells").alias("cell_index", "c")).select("page_id", "ord", "n_cells", "cell_index", "c.*")
    place = [F.rint(F.col(c) / SNAP) for c in ("x0", "y0", "x1", "y1")]
    here = Window.partitionBy("page_id", *place).orderBy("ord", "cell_index")
    first = cells.withColumn("nth", F.row_number().over(here)).where("nth = 1")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "cell_index"))
    return first.select("page_id", F.format_string("CELL-%02d-%04d", page, number).alias("cell_id"), "x0", "y0", "x1", "y1", "cell_index", "n_cells", (F.col("cell_index") == 0).alias("is_first"))
