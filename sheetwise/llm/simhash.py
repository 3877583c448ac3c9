"""SimHash near-duplicates with vantage-point trees.

A fingerprint takes the majority of each bit over the XXH64 hashes of a text's word shingles. A
vantage-point tree, built from a bounded sample, splits the fingerprints by their Hamming distance
to a vantage at each node. Each distinct fingerprint is stored in one leaf and queries every leaf
that the triangle inequality can't rule out; inside a leaf all distances are computed. Links join
into groups by connected components.

The tree's shape affects cost alone: every fingerprint is routed, and no leaf, link or group is cut
short. A leaf that outgrows its target is split into blocks, and each query visits each block. A
block returns a spanning forest of its links, so the links of a group of copies grow with the group,
not with its square.

Defined results: a null text is empty and its fingerprint is zero, linked like any other; a text
shorter than a shingle is one shingle; null ids take part, and a group's id is its smallest non-null
id (null if it has none); rows that repeat keep a row each; an empty table gives no rows; extra
columns are ignored. A bit that exactly half of the shingles set is 0. A very long text is hashed whole in its task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sheetwise.llm.common import connected_components, free_name, keep, map_texts, ship

SHINGLE = 3
RADIUS = 3
SAMPLE = 20_000
LEAF = 2048
MAX_DEPTH = 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; only A-Z are lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) > shingle else [words]
    hashes = np.fromiter((digest(b" ".join(p), 42) for p in parts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        block = hashes[i : i + 8192]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a long."""

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id bigint, fp bigint")


class Tree:
    """A complete binary vantage-point tree; node k has the children 2k+1 (near) and 2k+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.limit = np.full((1 << depth) - 1, 64, np.int64)
        rest = {0: sample}
        draw = np.random.default_rng(7)
        for k in range(len(self.vantage)):
            part = rest.pop(k)
            near = far = part[:0]
            if len(part):
                tries = draw.choice(part, min(8, len(part)), replace=False)
                spread = [np.bitwise_count(part ^ v).astype(np.float64).var() for v in tries]
                self.vantage[k] = v = tries[int(np.argmax(spread))]
                d = np.bitwise_count(part ^ v).astype(np.int64)
                self.limit[k] = int(np.median(d))
                near, far = part[d <= self.limit[k]], part[d > self.limit[k]]
            if 2 * k + 1 < len(self.vantage):
                rest[2 * k + 1], rest[2 * k + 2] = near, far

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``fps`` and the leaves where something within ``radius`` of them can lie."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[rows] ^ self.vantage[nodes]).astype(np.int64)
            near, far = d - radius <= self.limit[nodes], d + radius > self.limit[nodes]
            rows, nodes = np.concatenate([rows[near], rows[far]]), np.concatenate([2 * nodes[near] + 1, 2 * nodes[far] + 2])
        return rows, nodes - len(self.vantage)

    def home(self, fps: np.ndarray) -> np.ndarray:
        rows, leaves = self.route(fps, 0)  # at radius 0 one leaf each
        out = np.empty(len(fps), np.int64)
        out[rows] = leaves
        return out


class Forest:
    """Union-find over the linked fingerprints of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _link(forest: Forest, members: np.ndarray, queries: np.ndarray, radius: int) -> None:
    step = max(1, (1 << 18) // max(1, len(members)))
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        q, m = np.nonzero(np.bitwise_count(part[:, None] ^ members[None, :]) <= radius)
        other = part[q] != members[m]
        for a, b in zip(part[q[other]].view(np.int64).tolist(), members[m[other]].view(np.int64).tolist()):
            forest.join(a, b)


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that connect exactly the ``fp`` which chains of distances up to ``radius`` connect."""
    spark = distinct.sparkSession
    total = distinct.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / leaf))))
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit("vantage")), F.lit(1 << 30)) <= (1 << 30) * min(1.0, SAMPLE / max(1, total))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r.fp for r in picked.collect()], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree(sample, depth))

    def homes(batches):
        for batch in batches:
            leaves = tree.value.home(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, pa.int64())], names=["fp", "leaf"])

    at_home = keep(map_texts(distinct.select("fp"), homes, "fp bigint, leaf bigint"), "leaves")
    sizes = {r.leaf: r["count"] for r in at_home.groupBy("leaf").count().collect()}  # at most 2**MAX_DEPTH rows
    blocks = np.array([max(1, math.ceil(sizes.get(k, 0) / (4 * leaf))) for k in range(1 << depth)], np.int64)

    def sent(batches):
        for batch in batches:
            for piece in range(0, batch.num_rows, 4096):
                own, home = (batch.column(k).slice(piece, 4096).to_numpy() for k in (0, 1))
                fps = own.view(np.uint64)
                mixed = fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                stay = mixed.astype(np.int64) % blocks[home]
                rows, leaves = tree.value.route(fps, radius)
                many = blocks[leaves]
                block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows, leaves = np.repeat(rows, many), np.repeat(leaves, many)
                for fp, lf, bl, kind in ((own, home, stay, 0), (own[rows], leaves, block, 1)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lf << 24 | bl, pa.int64()), pa.array(np.full(len(fp), kind), pa.int32()), pa.array(fp, pa.int64())], names=["place", "kind", "fp"]
                    )

    def compare(batches):
        def close(forest):
            pairs = [(x, forest.root(x)) for x in list(forest.up)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        place, members, forest = None, [], Forest()
        for batch in batches:
            places, kinds, fps = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero(np.diff(places)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)]):
                if a == b:
                    continue
                if places[a] != place:
                    if forest.up:
                        yield close(forest)
                    place, members, forest = places[a], [], Forest()
                cut = a + int(np.searchsorted(kinds[a:b], 1))
                if cut > a:
                    members.append(fps[a:cut].view(np.uint64))
                if b > cut and members:
                    members = [np.concatenate(members)]
                    _link(forest, members[0], fps[cut:b].view(np.uint64), radius)
        if forest.up:
            yield close(forest)

    routed = map_texts(at_home, sent, "place bigint, kind int, fp bigint")
    return map_texts(routed.repartition("place").sortWithinPartitions("place", "kind"), compare, "a bigint, b bigint")


def _grouped(docs: DataFrame, shingle: int, radius: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of the rows, and (fp, root, component_id) of the distinct fingerprints."""
    own = keep(fingerprints(docs, shingle), "fingerprints")
    first = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_components(links(first, radius, leaf))
    named = keep(first.join(groups, first.fp == groups.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "groups")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own, named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each document."""
    own, label = _grouped(docs, shingle, radius, leaf)
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
