"""Removal of repeated passages: winnowed seeds, extended both ways to maximal repeats.

A window of ``LENGTH`` words holds ``LENGTH - SEED + 1`` seeds (runs of SEED words). Its anchor is
the seed of least hash, the rightmost of equals, so two equal windows share an anchor at the same
offset, and each window has one anchor. The job then needs only the anchors that occur twice or more:

1. count each anchor, and see whether all its occurrences extend alike;
2. an occurrence whose whole extension (all windows that it anchors) occurs again is a repeat;
3. the others are extended word by word: the hashes of their windows, and those of one occurrence
   of each kind found in step 2, are counted; windows counted twice or more are repeats.

Overlapping and adjacent repeats join into maximal ones, which are cut out of the text. Windows are
only ever counted under their anchor, never paired, so a passage that a third of all documents share
costs one row for each document. A false match needs equal 64-bit hashes of both anchor and window.

Defined results: a null text has no words; documents with equal ids are separate documents; rows
that repeat are repeats of each other; an empty table gives no rows; extra columns are ignored. A very long text is
taken whole, its anchors a task's work; windows of equal words all count, so there are no ties to break.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import keep, map_texts

LENGTH = 35
SEED = 8
_CACHE = 200_000
_B = 0x9E3779B97F4A7C15
# A place is packed as first window (30 bits), number of windows less one (5 bits), text hash (28 bits).
_SPAN, _TEXT = 5, 28


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 5)
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h
        return h


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            inverse = np.uint64(pow(_B, -1, 1 << 64))
            size = max(2 * n, 4096)
            grow = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
            self.up, self.down = grow(np.uint64(_B)), grow(inverse)
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(32)


class Hasher:
    """Hashes of word ranges of one text after another."""

    def __init__(self):
        self.words, self.powers = _WordHashes(), _Powers()

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        up, self.down = self.powers.to(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(hasher: Hasher, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor hash, extension hash, first window and last window of every anchor of a text."""
    n = len(words)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    hasher.load(words)
    at = np.arange(n - SEED + 1)
    seeds = hasher.ranges(at, at + SEED)
    size, value, place = 1, seeds, at

    def merged(v, p, shift):
        right = v[shift:] <= v[:-shift]
        return np.where(right, v[shift:], v[:-shift]), np.where(right, p[shift:], p[:-shift])

    target = LENGTH - SEED + 1
    while size < target:
        shift = min(size, target - size)
        value, place = merged(value, place, shift)
        size += shift
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    last = np.concatenate([first[1:], [len(place)]]) - 1
    spot = place[first]
    extension = hasher.ranges(first, last + LENGTH) + _mix(((spot - first) << 8 | (last - first)).astype(np.uint64))
    return seeds[spot], extension, first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _ids(docs: DataFrame) -> DataFrame:
    """id, th and text; th tells documents of equal id apart."""
    th = F.xxhash64("text").bitwiseAND((1 << _TEXT) - 1)
    return docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), th.alias("th"), "text", "doc_id")


def _occurrences(with_place: bool):
    def work(batches):
        hasher = Hasher()
        for batch in batches:
            found, rows = [[] for _ in range(4)], 0
            for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                seed, ext, first, last = anchors(hasher, words)
                found[0].append(seed)
                found[1].append(ext)
                if with_place:
                    found[2].append(np.full(len(seed), i, np.int64))
                    found[3].append((first << _SPAN | last - first) << _TEXT | th)
                rows += len(seed)
                if rows > 200_000:
                    yield pack(found)
                    found, rows = [[] for _ in range(4)], 0
            if found[0]:
                yield pack(found)

    def pack(found):
        names = ["anchor", "ext", "id", "place"]
        k = 4 if with_place else 2
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(x)) for x in found[:k]], names=names[:k])

    return work


def _windows(batches):
    """The windows of the places given for each text."""
    hasher = Hasher()
    for batch in batches:
        out = [[] for _ in range(5)]
        for i, th, text, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
            hasher.load((text or "").encode().split())
            anchor = np.array([p["anchor"] for p in places], np.int64)
            place = np.array([p["place"] for p in places], np.int64)
            single = np.array([p["single"] for p in places], bool)
            first, count = place >> _SPAN + _TEXT, (place >> _TEXT & (1 << _SPAN) - 1) + 1
            start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            for k, x in enumerate((np.repeat(anchor, count), hasher.ranges(start, start + LENGTH), np.full(len(start), i, np.int64), start << _TEXT | th)):
                out[k].append(x)
            out[4].append(np.repeat(single, count))
        if out[0]:
            yield pa.RecordBatch.from_arrays([*(_signed(np.concatenate(x)) for x in out[:4]), pa.array(np.concatenate(out[4]))], names=["anchor", "window", "id", "start", "single"])


def repeats(docs: DataFrame) -> DataFrame:
    """(id, th, spans): the words covered by repeated windows, as an array of (start, end) for each text that has some."""
    texts = _ids(docs)
    counted = map_texts(texts.select("id", "th", "text"), _occurrences(False), "anchor bigint, ext bigint")
    again = counted.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ext").alias("least"), F.max("ext").alias("most")).where("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("alike"))
    again = keep(again, "anchors")  # read from a table, a hot anchor's side of the join can be split
    found = map_texts(texts.select("id", "th", "text"), _occurrences(True), "anchor bigint, ext bigint, id bigint, place bigint")
    found = keep(found.join(again, "anchor"), "repeated-anchors")

    unlike = found.where("not alike")
    kinds = unlike.groupBy("anchor", "ext").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one"))
    kinds = keep(kinds, "extensions")
    whole = found.where("alike").select("id", "place").union(
        unlike.join(kinds.where("n > 1").select("anchor", "ext"), ["anchor", "ext"], "left_semi").select("id", "place")
    )
    probes = (
        kinds.select("one.id", F.col("one.place").bitwiseAND((1 << _TEXT) - 1).alias("th"), F.struct("anchor", "one.place", (F.col("n") == 1).alias("single")).alias("p"))
        .groupBy("id", "th").agg(F.collect_list("p").alias("places"))
    )
    probed = texts.select("id", "th", "text").join(probes, ["id", "th"]).select("id", "th", "text", "places")
    windows = keep(map_texts(probed, _windows, "anchor bigint, window bigint, id bigint, start bigint, single boolean"), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    single = windows.where("single").join(keep(twice, "repeated-windows"), ["anchor", "window"], "left_semi")

    mask = (1 << _TEXT) - 1
    first = F.shiftright("place", _SPAN + _TEXT)
    size = F.shiftright("place", _TEXT).bitwiseAND((1 << _SPAN) - 1)
    spans = whole.select("id", F.col("place").bitwiseAND(mask).alias("th"), F.struct(first.cast("int").alias("a"), (first + size + LENGTH).cast("int").alias("b")).alias("s")).union(
        single.select("id", F.col("start").bitwiseAND(mask).alias("th"), F.struct(F.shiftright("start", _TEXT).cast("int").alias("a"), (F.shiftright("start", _TEXT) + LENGTH).cast("int").alias("b")).alias("s"))
    )
    return spans.groupBy("id", "th").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): the text without its repeated passages."""

    def work(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                for s in spans.as_py() or ():
                    cover[s["a"]] += 1
                    cover[s["b"]] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            n = 3 + with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:n]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: n + 1])

    joined = _ids(docs).join(repeats(docs), ["id", "th"], "left").select("doc_id", "text", "spans")
    return map_texts(joined, work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
