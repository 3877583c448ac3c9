"""Pages of two revisions as gray tiles: what changed, and in how many regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.scratch import keep, keep_last
from sheetwise.tasks import ship

THRESHOLD = 15
# In tiles: a lone changed tile grows to 9 and isn't a region.
CLOSE, DILATE, MIN_SIZE = 1, 1, 9
KEY = ("pair_id", "page")
#: Rows of tiles whose runs one task joins at a time.
BAND = 1024


def page_tile_diff(tiles: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(pair_id, page, tx, ty): tiles that differ by more than ``threshold`` or that one revision lacks."""
    side = lambda rev: tiles.where(F.col("rev") == rev).select(*KEY, "tx", "ty", F.col("gray").alias(f"gray{rev}"))
    both = side(1).join(side(2), [*KEY, "tx", "ty"], "full")
    return both.where(F.coalesce(F.abs(F.col("gray1") - F.col("gray2")) > threshold, F.lit(True))).select(*KEY, "tx", "ty")


class Sets(dict):
    """Disjoint sets: each member leads to the least of its set."""

    def least(self, k):
        while (up := self.setdefault(k, k)) != k:
            self[k] = k = self[up]
        return k

    def unite(self, a, b):
        a, b = self.least(a), self.least(b)
        self[max(a, b)] = min(a, b)


def _groups(batches, keys: list[str]):
    """Rows of sorted batches, a list of tuples for each value of ``keys``, which come first."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[: len(keys)] != now:
                if held:
                    yield held
                held, now = [], row[: len(keys)]
            held.append(row)
    if held:
        yield held


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _around(keys: np.ndarray, width: int, reach: int) -> np.ndarray:
    """All keys within ``reach`` of each of ``keys``, as often as they are; a key is row * ``width`` + column."""
    steps = np.arange(-reach, reach + 1)
    return (keys[:, None] + (steps[:, None] * width + steps).ravel()).ravel()


def grown(keys: np.ndarray, width: int, close: int, dilate: int) -> np.ndarray:
    """The sorted tiles that are left after closing and dilation."""
    keys = np.unique(keys)
    if close:
        near, votes = np.unique(_around(np.unique(_around(keys, width, close)), width, close), return_counts=True)
        keys = near[votes == (2 * close + 1) ** 2]
    return np.unique(_around(keys, width, dilate)) if dilate else keys


def joined_runs(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int) -> np.ndarray:
    """For runs sorted by row and column, the place of the first run of each one's region; runs of rows next to each other touch by side or corner."""
    begin, end = row * width + x0, row * width + x1
    # Of the next row, the runs from the first that ends behind this one's left neighbour to the last that begins before its right one.
    low, high = np.searchsorted(end, begin + width - 1, "left"), np.searchsorted(begin, end + width + 1, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(row))
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _firsts(columns: list[pa.Array]) -> np.ndarray:
    """Places where a row of sorted columns differs from the one before, and 0."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        codes = [c.dictionary_encode("encode").indices.to_numpy() for c in columns]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return np.flatnonzero(new)


def _pieces(batches):
    """Sorted batches, cut and joined so that no (pair_id, page, band) stands in two of them, each of some thousand rows or one such group."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_firsts(batch.columns[:3])[-1])
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _labelled(tiles: DataFrame, close: int, dilate: int) -> DataFrame:
    """(pair_id, page, band, ty, x0, x1, label): runs of the closed and dilated ``tiles``; ``label`` is the number of the first tile of the region that the run belongs to within its band of rows.

    A tile goes to each band that it may reach into, so that bands are grown by themselves. Tiles are shuffled once here; a task
    works on some thousand of them at a time, of many pages together.
    """
    kinds, reach = dict(tiles.dtypes), 2 * close + dilate
    ddl = ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", band bigint, ty bigint, x0 bigint, x1 bigint, label bigint"
    band = lambda d: F.floor((F.col("ty").cast("long") + d) / rows)
    rows = BAND
    dealt = tiles.select(*KEY, F.explode(F.sequence(band(-reach), band(reach))).alias("band"), F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))
    dealt = dealt.repartition(*KEY, "band").sortWithinPartitions(*KEY, "band")

    def work(batches):
        for t in _pieces(batches):
            first = _firsts(t.columns[:3])
            group = np.repeat(np.arange(len(first)), np.diff([*first, t.num_rows]))
            bands, ty, tx = (t.column(k).to_numpy() for k in (2, 3, 4))
            left, top, height = int(tx.min()) - reach - 1, bands * rows - 2 * reach - 1, rows + 4 * reach + 3
            width = int(tx.max()) - left + reach + 3
            made = grown((group * height + ty - top) * width + tx - left, width, close, dilate)
            if not len(made):
                continue
            own, x = np.divmod(made, width)
            group, place = np.divmod(own, height)
            y = place + top[first[group]]
            mine = (y >= bands[first[group]] * rows) & (y < (bands[first[group]] + 1) * rows)
            made, own, x, y, group = made[mine], own[mine], x[mine], y[mine], group[mine]
            if not len(made):
                continue
            starts = np.flatnonzero(np.concatenate([[True], np.diff(made) != 1]))
            ends = np.concatenate([starts[1:] - 1, [len(made) - 1]])
            label = joined_runs(own[starts], x[starts], x[ends], width)
            y, x0, x1 = y[starts], x[starts] + left, x[ends] + left
            found = [pa.array(c, pa.int64()) for c in (y, x0, x1, y[label] * (1 << 32) + x0[label])]
            place = pa.array(first[group[starts]])
            yield pa.RecordBatch.from_arrays([*(c.take(place) for c in t.columns[:3]), *found], names=[*KEY, "band", "ty", "x0", "x1", "label"])

    ship(tiles.sparkSession)
    return dealt.mapInArrow(work, ddl)


def _noting(batches, note: list):
    for batch in batches:
        note.append(batch.schema) if not note else None
        yield batch


def _contracted(labelled: DataFrame) -> DataFrame | None:
    """(pair_id, page, label, root) of labels that meet across a border of bands; None if none do.

    Only runs of the two rows at a border are compared, so what a page's task holds grows with its borders, not with its regions.
    """
    last = labelled.where(F.col("ty") == F.col("band") * BAND + BAND - 1).select(*KEY, (F.col("ty") + 1).alias("ty"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a"))
    first = labelled.where(F.col("ty") == F.col("band") * BAND).select(*KEY, "ty", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("label").alias("b"))
    meet = (F.col("b0") <= F.col("a1") + 1) & (F.col("b1") >= F.col("a0") - 1)
    edges = keep(last.join(first, [*KEY, "ty"]).where(meet).select(*KEY, "a", "b").distinct(), "borders")
    if not edges.take(1):
        return None
    kinds = dict(edges.dtypes)

    def work(batches):
        for rows in _groups(_noting(batches, note := []), list(KEY)):
            sets = Sets()
            for *_, a, b in rows:
                sets.unite(a, b)
            schema = pa.schema([*list(note[0])[: len(KEY)], pa.field("label", pa.int64()), pa.field("root", pa.int64())])
            yield _table([(*rows[0][: len(KEY)], k, sets.least(k)) for k in list(sets)], schema)

    return edges.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", label bigint, root bigint")


def diff_regions(changed: DataFrame, close: int = 1, dilate: int = 1, min_size: int = 0) -> DataFrame:
    """(pair_id, page, region, size, x0, y0, x1, y1): 8-connected regions of changed tiles with more than ``min_size`` tiles.

    Gaps are closed and the tiles dilated first. Within bands of BAND rows tiles are grown, become runs and are joined, and labels that meet at a border of
    bands are joined once a page: there are no rounds, however long a region is. ``region`` is the number of its first tile. Regions don't
    join across pages; closing and dilation aren't cut at a page's edge, so size and box count the margin there too.
    """

    def make():
        labelled = keep(_labelled(changed, close, dilate), "runs")
        roots = _contracted(labelled)
        if roots is not None:
            labelled = labelled.join(roots, [*KEY, "label"], "left").withColumn("label", F.coalesce("root", "label"))
        return labelled.groupBy(*KEY, F.col("label").alias("region")).agg(
            F.sum(F.col("x1") - F.col("x0") + 1).alias("size"), F.min("x0").cast("int").alias("x0"), F.min("ty").cast("int").alias("y0"), F.max("x1").cast("int").alias("x1"), F.max("ty").cast("int").alias("y1")
        ).where(F.col("size") > min_size)

    return keep_last(make, "regions")


def changed_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, page, regions, changed) of every page pair; ``changed`` is false for a pair without a changed page."""
    n = regions.groupBy(*KEY).agg(F.count("*").alias("regions"))
    both = pages.join(n, list(KEY), "left")
    some = both.groupBy("pair_id").agg(F.max(F.col("regions").isNotNull()).alias("changed"))
    return both.join(some, "pair_id").where(F.col("regions").isNotNull() | ~F.col("changed")).select(*KEY, F.coalesce("regions", F.lit(0)).alias("regions"), "changed")


def highlight_boxes(regions: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """(pair_id, page, region, x0, y0, x1, y1): each region's box in pixels, grown by a padding and kept within the page.

    ``tile``: pixels of a tile's side. The padding is a 250th of the page's shorter side, 4 at least.
    """
    pad = max(4, min(width, height) // 250)
    low = lambda c: F.greatest(F.lit(0), F.col(c) * tile - pad).alias(c)
    high = lambda c, most: F.least(F.lit(most), (F.col(c) + 1) * tile + pad).alias(c)
    return regions.select(*KEY, "region", low("x0"), low("y0"), high("x1", width), high("y1", height))
