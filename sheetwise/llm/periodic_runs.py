"""Periodic runs of words, by seeds on diagonals.

A run is a stretch whose words ``q`` apart are identical, at least ``MIN_REPEATS * q`` and ``MIN_LENGTH``
words long, that can't be made longer; ``q`` is its smallest period. On the diagonal of lag ``q`` such a
run matches itself for at least ``(MIN_REPEATS - 1) * q`` words. So lags are taken in classes ``lo`` to
``hi``, where ``hi`` is one and a half times ``lo``: each run of a class holds two occurrences, ``q``
apart, of a ``k``-gram of the overlap that ``lo`` guarantees. As ``k`` is two periods or more, the k-gram
can't stand in between (its smaller period would be that of the run), so occurrences are paired with the
next of the same k-gram alone: pairs grow with the text, however often a phrase comes.

A pair is extended both ways along its diagonal, block by block. A table of the furthest word covered
for each lag suppresses pairs that an earlier extension has passed. K-grams are named exactly, by
doubling, so no hash can hide a pair.

Defined results: a null text has no words and no runs; one word repeated is a run of period 1; of runs
of equal length the first, then the one of smaller period is the longest; a run of period ``q`` isn't
told again as one of ``2q``; repeated rows keep a row each; an empty table gives no rows; extra columns
are ignored. A text of n words takes time of the order n log n and memory of the order n, words of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_texts

MIN_LENGTH, MIN_REPEATS = 6, 4

SCHEMA = (
    "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
    "longest struct<start: bigint, length: bigint, period: bigint>, collapsed string"
)
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_KINDS, _NAMES = (pa.int64(), pa.list_(_RUN), _RUN, pa.string()), ["doc_id", "n_words", "runs", "longest", "collapsed"]


def classes(n: int) -> list[tuple[int, int, int]]:
    """(lo, hi, k) of the lags that a run of ``n`` words can have; k words match at any lag of the class."""
    out, lo = [], 1
    while MIN_REPEATS * lo <= n:
        k = max((MIN_REPEATS - 1) * lo, MIN_LENGTH - lo)
        out.append((lo, k // 2, k))
        lo = k // 2 + 1
    return out


def _next_alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and their distances to the next place with the same key."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    first = order[:-1][same]
    return first, order[1:][same] - first


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two equally long arrays agree, looked at in doubling blocks."""
    at, size = 0, 64
    while at < len(a):
        differ = a[at : at + size] != b[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, 2 * size
    return len(a)


def _shorter_period(ids: np.ndarray, start: int, length: int, lag: int) -> bool:
    """Whether a proper divisor of ``lag`` is a period of the stretch; at four periods no other number can be one."""
    rest, p = lag, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = lag // p
            if np.array_equal(ids[start : start + length - d], ids[start + d : start + length]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a row of numbers, by start, then period."""
    n, found = len(ids), []
    name, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1  # names of all grams of ``width`` words
    for lo, hi, k in classes(n):
        while 2 * width <= k:
            name = np.unique(name[:-width] * n + name[width:], return_inverse=True)[1].astype(np.int64)
            width *= 2
        # Two grams of ``width`` words, which overlap or touch, name the k-gram.
        places, lags = _next_alike(name[: n - k + 1] * n + name[k - width : n - width + 1])
        if not len(places):
            break  # no k-gram comes twice, so none of a longer class does
        fit = (lags >= lo) & (lags <= hi)
        places, lags = places[fit], lags[fit]
        order = np.argsort(places)
        covered: dict[int, int] = {}  # for each lag, where the match on its diagonal ends
        for i, lag in zip(places[order].tolist(), lags[order].tolist()):
            if i < covered.get(lag, 0):
                continue
            end = i + k + _matching(ids[i + k : n - lag], ids[i + lag + k :])
            start = i - _matching(ids[:i][::-1], ids[lag : i + lag][::-1])
            covered[lag] = end
            length = end + lag - start
            if length >= max(MIN_LENGTH, MIN_REPEATS * lag) and not _shorter_period(ids, start, length, lag):
                found.append((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run repeats: of each run its first period stays, unless another run drops it."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def stretched(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the documents' digest: those of one id in ten, by checksum, repeat a stretch from some place on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """One row of SCHEMA for each document: its runs, the longest, and its words without the repeats; one pass, no shuffle.

    ``prepare``, if given, makes the words to look at from a document's words and its id.
    """

    def measure(doc_id, text):
        words = (text or "").encode().split()  # of bytes: at the ASCII white space
        words = prepare(words, doc_id) if prepare else words
        runs = find_runs(numbered(words))
        kept = kept_words(len(words), runs)
        return len(words), [_record(r) for r in runs], _record(longest(runs)), b" ".join(w for w, k in zip(words, kept) if k).decode()

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [measure(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), _KINDS))], names=_NAMES)

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def _record(run: tuple[int, int, int] | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of what ``periodic_runs`` returns."""
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
