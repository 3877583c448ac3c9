"""Alignment of two tokenizers over the same texts, by byte ranges.

A batch of documents is encoded by both. ``merge_asof``, keyed by document, finds for each token's start
the token of the other side that covers it; both directions together are all overlaps (links), each once.
Places where tokens of both sides end cut a document into groups.

How often a pair of ids is linked in the whole corpus comes back to documents by blocks: a block of about
BLOCK_BYTES of text holds its distinct pairs once, its documents point to them, and each pair of a block meets its count
in one shuffle. A pair that every document has comes once a block, and no dictionary of all pairs is sent around.

Defined results: null and empty texts, and texts whose tokens don't spell a space and the text, have no
tokens; special strings are plain text; an empty table gives no rows; repeated rows keep a row each and count each;
a null id is kept; extra columns are ignored. A very long text is a block of its own; time and memory grow with its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import keep, map_texts

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
_LONG_GAP = re.compile(r"\s{2000}")

ALIGNED = "doc_id bigint, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, groups string"
_BLOCKS = (
    "block string, pairs array<bigint>, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, groups_sha256 array<string>, sizes array<int>, at binary, times binary"
)
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
TOTALS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class ByteLevel:
    """Byte-level merges of a ``tokenizers`` file: ids, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        special = {t["content"] for t in d["added_tokens"]}
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; the others follow 255
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(seen)))}
        self.bytes = {k: bytes(map(byte.__getitem__, w)) for w, k in d["model"]["vocab"].items() if w not in special}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # The same vocabulary and merges; its pattern can't pass very long gaps, which are left to the file's own library.
        ranks = {w: k for k, w in self.bytes.items()}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        one = lambda t: self.library.encode(t, add_special_tokens=False).ids if _LONG_GAP.search(t) else self.fast.encode_ordinary(t)
        return [one(" " + t) for t in texts]


class Pieces:
    """Pieces of a ``sentencepiece`` model, which adds the space itself: ids, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = {k: bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in zip(ids, map(self.model.id_to_piece, ids))}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Encoders:
    """Both sides, with the byte length of each id, and the texts of ids as a group is written."""

    def __init__(self, first: str, second: str):
        import public_tokenizers

        self.sides = ByteLevel(public_tokenizers.path(first)), Pieces(public_tokenizers.path(second))
        self.top = max(max(side.bytes) for side in self.sides) + 1
        self.spelt = [[side.bytes.get(k, b"") for k in range(self.top)] for side in self.sides]
        self.lengths = [np.fromiter(map(len, own), np.int64, self.top) for own in self.spelt]
        self.texts = [f"{k}{s}" for s in ",|;" for k in range(self.top)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side, ids of all tokens and the text that each belongs to; none where a side doesn't spell the text."""
        full = [t or "" for t in texts]
        plain = [b" " + t.encode() for t in full]
        ids = [side.encode(full) for side in self.sides]
        ok = [t != "" and all(b"".join(map(spelt.__getitem__, own[k])) == plain[k] for spelt, own in zip(self.spelt, ids)) for k, t in enumerate(full)]
        out = []
        for side in ids:
            own = [x if good else [] for x, good in zip(side, ok)]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            out.append((np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())), np.repeat(np.arange(len(own)), sizes)))
        return out


@cache
def _encoders(first: str, second: str) -> Encoders:
    return Encoders(first, second)


class Aligned:
    """Tokens, links and groups of a batch of texts; tokens are numbered through the batch."""

    def __init__(self, encoders: Encoders, texts: list[str | None]):
        self.n = len(texts)
        (self.a, self.a_row), (self.b, self.b_row) = encoders.tokens(texts)
        a_end, b_end = np.cumsum(encoders.lengths[0][self.a]), np.cumsum(encoders.lengths[1][self.b])
        a_start, b_start = a_end - encoders.lengths[0][self.a], b_end - encoders.lengths[1][self.b]
        left = pd.DataFrame({"at": a_start, "document": self.a_row, "a": np.arange(len(self.a))})
        right = pd.DataFrame({"at": b_start, "document": self.b_row, "b": np.arange(len(self.b))})
        over_a = pd.merge_asof(left, right, on="at", by="document")["b"].to_numpy(np.int64)
        over_b = pd.merge_asof(right, left, on="at", by="document")["a"].to_numpy(np.int64)
        new = np.flatnonzero(a_start[over_b] != b_start)  # tokens that start together were found from the first side
        self.link_a = np.concatenate([left["a"].to_numpy(), over_b[new]])
        self.link_b = np.concatenate([over_a, new])
        self.cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_start, "right"), np.searchsorted(self.cuts, b_start, "right")
        self.cut_row = self.a_row[np.searchsorted(a_end, self.cuts)]

    def per_text(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=self.n)

    def groups(self, encoders: Encoders) -> list[str]:
        """a1,a2|b1;a3|b2 of each text: the ids of both sides, group by group."""
        a_of, b_of = (np.bincount(g, minlength=len(self.cuts)) for g in (self.a_group, self.b_group))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, group, before, other, last in ((self.a, self.a_group, np.cumsum(b_of) - b_of, 0, 1), (self.b, self.b_group, np.cumsum(a_of), 1, 2)):
            ends = np.ones(len(ids), bool)
            ends[:-1] = group[1:] != group[:-1]
            code[np.arange(len(ids)) + before[group]] = ids + np.where(ends, last, 0) * encoders.top
        size = self.per_text(self.a_row) + self.per_text(self.b_row)
        end = np.cumsum(size)
        text = encoders.texts.__getitem__
        return ["".join(map(text, code[e - s : e].tolist()))[:-1] for s, e in zip(size.tolist(), end.tolist())]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, about BLOCK_BYTES of text at a time."""
    for batch in batches:
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), np.int64)
        begin = 0
        while begin < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), BLOCK_BYTES, "right")))
            part = batch.slice(begin, n)
            begin += n
            yield part.column(0), part.column(1).to_pylist()


def alignments(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row of ALIGNED for each document: ids of both sides, overlapping token positions, groups; one pass, no shuffle."""

    def work(batches):
        encoders = _encoders(first, second)
        kinds = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.string()
        for ids, texts in _parts(batches):
            x = Aligned(encoders, texts)
            a0, b0 = np.searchsorted(x.a_row, np.arange(x.n + 1)), np.searchsorted(x.b_row, np.arange(x.n + 1))
            order = np.lexsort((x.link_b, x.link_a))
            la, lb = x.link_a[order], x.link_b[order]
            l0 = np.searchsorted(la, a0)
            links = [[{"a": i, "b": j} for i, j in zip((la[s:e] - a).tolist(), (lb[s:e] - b).tolist())] for s, e, a, b in zip(l0, l0[1:], a0, b0)]
            columns = [x.a[s:e] for s, e in zip(a0, a0[1:])], [x.b[s:e] for s, e in zip(b0, b0[1:])], links, x.groups(encoders)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split()[0] for c in re.split(r", (?![ab]: )", ALIGNED)])

    return map_texts(docs.select("doc_id", "text"), work, ALIGNED)


def blocks(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Blocks of documents: counts of each, and the linked pairs of ids, of which the block holds each once.

    A pair is a_id * 2**32 + b_id. ``at`` and ``times`` list for each document the places of its pairs in the block's and how often it
    has them, ``sizes`` of them a document.
    """

    def work(batches):
        from pyspark import TaskContext

        encoders, task = _encoders(first, second), TaskContext.get()
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        kinds = [pa.list_(pa.int64())] * 6 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for k, (ids, texts) in enumerate(_parts(batches)):
            x = Aligned(encoders, texts)
            pairs, pair = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True)
            row = x.a_row[x.link_a]
            own, times = np.unique(row * len(pairs) + pair, return_counts=True)
            holder, at = np.divmod(own, max(1, len(pairs)))
            counts = [x.per_text(r) for r in (x.a_row, x.b_row, x.cut_row, row)]
            told = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups(encoders)]
            columns = [pairs, ids.to_pylist(), *counts, told, x.per_text(holder), at.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{task.partitionId()}-{k}"]), *(pa.array([c], t) for c, t in zip(columns, kinds))], names=names)

    return map_texts(docs.select("doc_id", "text"), work, _BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all blocks, and whether no pair of the same b_id has more.

    Counts are summed in each block's task before the shuffle.
    """

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pairs = batch.column(0)[k].values
                at, times = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in (1, 2))
                n = np.bincount(at, times, minlength=len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pairs, pa.array(n)], names=["pair", "n"])

    held = map_texts(made.select("pairs", "at", "times"), work, "pair bigint, n bigint")
    counts = keep(held.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(second.alias("b_id")).agg(F.max("n").alias("most"))
    return counts.join(most, second == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def totals(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row of TOTALS for each document: its counts, and what its links are worth in the corpus."""
    made = keep(blocks(docs, first, second), "aligned-blocks")
    held = made.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = held.join(pair_counts(made), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    both = made.drop("pairs").join(known, "block", "left")

    def work(batches):
        names = [c.split()[0] for c in TOTALS.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k]  # noqa: E731, B023
                found = get("known").values
                n, best = np.zeros(len(found or ()), np.int64), np.zeros(len(found or ()), np.int64)
                if found is not None:
                    place = found.field("place").to_numpy()
                    n[place], best[place] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                at, times = (np.frombuffer(get(c).as_py(), np.int32) for c in ("at", "times"))
                ends = np.concatenate([[0], np.cumsum(get("sizes").values.to_numpy())])
                worth = [np.concatenate([[0], np.cumsum(times * w[at])]) for w in (best, n)]
                sums = [pa.array(w[ends[1:]] - w[ends[:-1]]) for w in worth]
                yield pa.RecordBatch.from_arrays([*(get(c).values for c in ("doc_id", *_COUNTS)), *sums, get("groups_sha256").values], names=names)

    return map_texts(both, work, TOTALS)
