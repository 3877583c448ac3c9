"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then verification.

Test items form an inverted index. Each weight is divided by the score that the item has against
itself, so one threshold serves all items. Every passage of every training document (overlapping
windows, twice as long as the longest item of its length class) is a query. A term's postings are
cut into blocks of items, each with its largest weight. Pivots tell which lists a passage has to open; blocks
that no opened list names are skipped before any sum, then those whose bound stays under the threshold. The
others are scored exactly, so every item above the threshold is retrieved. Passages are worked on together, in arrays.
Each hit is verified by the share of the item's five-word shingles that the passage holds: in the
question, in the answer and in the whole item.

The index reaches tasks by broadcast in parts of at most about PART_CHARS characters of items; more
items make more parts, and each part is a further pass over the documents.

Defined results: null texts and texts without words hit nothing and are never hit; an item shorter
than a shingle is one shingle; items or documents that repeat keep a row each (documents with equal
ids each report their own hits); of items with one score each is a hit, and of passages of a document the best counts; a very long
text is searched whole, passage by passage; empty tables give no rows; extra columns are ignored, but the items'
columns question and answer, where they exist, replace the split of the text at its last sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import filter_texts, keep, map_texts

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
PART_CHARS = 4_000_000
#: Items of a block.
BLOCK = 2
#: Cuts of lists opened at a time, unless one cell opens more.
LIVE = 500_000
#: The part of the threshold that unopened lists may reach.
PIVOT = 0.3
#: What sums of bounds may lose to rounding.
SLACK = 1e-6
_TERM = re.compile(r"\w+")
_LAST = re.compile(r"(.*[.!?\n])\s*(\S.*)", re.S)


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, if there is another."""
    m = _LAST.fullmatch(text.strip())
    return (m[1], m[2]) if m else (text, "")


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if ids else set()


def _share(part: set, held: list[set]) -> float:
    """Share of ``part`` in the passage; ``held``: its shingles by length."""
    return sum(x in held[len(x)] for x in part) / len(part) if part else 1.0


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... up to count[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """Postings of the items of one length class.

    Each term has a list of (item, weight), cut where the items' numbers enter another block of BLOCK items, with the
    largest weight of each cut and of the list. Terms are numbered from the longest list to the shortest.
    """

    def __init__(self, items: list[tuple], vocabulary: dict[str, int], idf: np.ndarray, mean_length: float):
        self.items = [x[0] for x in items]
        self.cell = max(len(x[1]) for x in items)
        self.cell += self.cell // 4 + 1
        self.blocks = math.ceil(len(items) / BLOCK)
        term, item, weight = [], [], []
        for k, (_, terms, _, _) in enumerate(items):
            counts = Counter(vocabulary[t] for t in terms)
            norm = K1 * (1 - B + B * len(terms) / mean_length)
            w = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in counts.items()}
            total = sum(w.values())
            term.extend(w)
            item.extend([k] * len(w))
            weight.extend(x / total for x in w.values())
        known, size = np.unique(term, return_counts=True)
        known = known[np.argsort(-size, kind="stable")]
        self.terms = len(known)
        self.row = np.full(len(vocabulary) + 1, -1, np.int64)  # the last stands for unknown terms
        self.row[known] = np.arange(self.terms)
        term, item, weight = self.row[term], np.array(item, np.int64), np.array(weight)
        order = np.lexsort((item, term))
        self.term, self.item, self.weight = term[order], item[order], weight[order]
        key = self.term * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block_key = key[first]
        self.block_start = np.append(first, len(key))
        self.block_most = np.maximum.reduceat(self.weight, first)
        self.list_start = np.searchsorted(self.block_key, np.arange(self.terms + 1) * self.blocks)
        self.list_most = np.maximum.reduceat(self.block_most, self.list_start[:-1])
        ids = lambda terms: [vocabulary[t] for t in terms]
        self.parts = [(ids(q), ids(a), ids(terms)) for _, terms, q, a in items]

    @property
    def weights(self) -> list[dict[int, float]]:
        """The weights of each item by term."""
        out = [{} for _ in self.items]
        for t, k, w in zip(self.term.tolist(), self.item.tolist(), self.weight.tolist()):
            out[k][t] = w
        return out

    def search(self, tokens: np.ndarray, starts: np.ndarray, threshold: float):
        """(document, item, score, token range) of each hit; ``starts``: where each document's tokens begin, and the end.

        A passage is two neighbouring cells of a document. An item that reaches the threshold reaches half of it in one
        of them. The pivot of a cell is the term at which the largest weights of its lists, the longest first, come to
        the part PIVOT of that half: terms before it can't reach the half without one behind it, so only the lists
        behind it are opened. An earlier pivot opens more lists and leaves tighter bounds.
        """
        lengths = np.diff(starts)
        cells = (lengths + self.cell - 1) // self.cell
        base = np.concatenate([[0], np.cumsum(cells)])
        rows = self.row[tokens]
        known = np.flatnonzero(rows >= 0)
        doc = np.searchsorted(starts, known, side="right") - 1
        held = np.unique((base[doc] + (known - starts[doc]) // self.cell) * self.terms + rows[known])
        if not len(held):
            return
        cell, term = held // self.terms, held % self.terms
        at = np.searchsorted(cell, np.arange(base[-1] + 2))
        follows = np.ones(base[-1], bool)
        follows[base[1:][cells > 0] - 1] = False  # the last cell of a document has none after it
        most = self.list_most[term]
        total = np.concatenate([[0.0], np.cumsum(most)])
        behind = total[1:] - total[at[cell]] >= threshold * PIVOT / 2 - SLACK
        before = np.bincount(cell[~behind], most[~behind], base[-1] + 1)
        bound = total[at[1:]] - total[at[:-1]]
        used = bound[:-1] + np.where(follows, bound[1:], 0) >= threshold - SLACK
        used[1:] |= used[:-1] & follows[:-1]
        entry = np.flatnonzero(behind & used[cell])
        work = np.bincount(cell[entry], self.list_start[term[entry] + 1] - self.list_start[term[entry]], base[-1])
        work = np.concatenate([[0], np.cumsum(work)])
        low = 0
        while low < base[-1]:
            high = max(low + 1, int(np.searchsorted(work, work[low] + LIVE, side="right")) - 1)
            inside = entry[np.searchsorted(cell[entry], low) : np.searchsorted(cell[entry], high + 1)]
            spots, blocks = self._live(cell[inside], term[inside], low, high, follows, before, threshold)
            for i in range(0, len(spots), 4096):
                c = spots[i : i + 4096]
                for owner, k, score in self._scores(c, blocks[i : i + 4096], at, term, follows, threshold):
                    d = int(np.searchsorted(base, c[owner], side="right")) - 1
                    begin = starts[d] + (c[owner] - base[d]) * self.cell
                    yield d, k, score, begin, min(starts[d + 1], begin + 2 * self.cell)
            low = high

    def _live(self, cell, term, low, high, follows, before, threshold):
        """(passage, block) of the passages from ``low`` to ``high`` whose opened lists and the bound of the rest reach the threshold."""
        first, count = self.list_start[term], self.list_start[term + 1] - self.list_start[term]
        cut = _ranges(first, count)
        live, which = np.unique(np.repeat(cell, count) * self.blocks + self.block_key[cut] % self.blocks, return_inverse=True)
        opened = np.bincount(which, self.block_most[cut])
        c = live // self.blocks
        begins, ends = c < high, (c > low) & follows[c - 1]
        pairs, which = np.unique(np.concatenate([live[begins], live[ends] - self.blocks]), return_inverse=True)
        bound = np.bincount(which, np.concatenate([opened[begins], opened[ends]]))
        spot = pairs // self.blocks
        good = bound + before[spot] + np.where(follows[spot], before[spot + 1], 0) >= threshold - SLACK
        return spot[good], pairs[good] % self.blocks

    def _scores(self, spots, blocks, at, term, follows, threshold):
        """(number of the pair, item, score) of the items at or above the threshold in pairs of passage and block."""
        first, count = at[spots], at[spots + 1 + follows[spots]] - at[spots]
        owner = np.repeat(np.arange(len(spots)), count)
        inside = term[_ranges(first, count)]
        key = inside * self.blocks + blocks[owner]
        cut = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        hit = self.block_key[cut] == key
        owner, cut = owner[hit], cut[hit]
        good = (np.bincount(owner, self.block_most[cut], len(spots)) >= threshold - SLACK)[owner]
        once = np.unique(owner[good] * len(self.block_key) + cut[good])  # a term of both cells counts once
        owner, cut = once // len(self.block_key), once % len(self.block_key)
        first, count = self.block_start[cut], self.block_start[cut + 1] - self.block_start[cut]
        post = _ranges(first, count)
        pairs, which = np.unique(np.repeat(owner, count) * len(self.items) + self.item[post], return_inverse=True)
        scores = np.bincount(which, self.weight[post])
        for i in np.flatnonzero(scores >= threshold).tolist():
            yield *divmod(int(pairs[i]), len(self.items)), float(scores[i])


def build(items: list[tuple], document_frequency: dict[str, int], total: int, mean_length: float) -> tuple[dict[str, int], list[Index]]:
    """Vocabulary, and an index for each length class; ``items``: (item_id, terms, question terms, answer terms)."""
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms, q, a in items for t in (*terms, *q, *a)}))}
    df = np.array([document_frequency.get(t, 1) for t in sorted(vocabulary)], np.float64)
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    classes = defaultdict(list)
    for x in items:
        classes[math.ceil(math.log(max(1, len(x[1])), 4))].append(x)
    return vocabulary, [Index(x, vocabulary, idf, mean_length) for _, x in sorted(classes.items())]


def _find(indexes, vocabulary, texts, threshold):
    """(text number, item_id, score, question, answer and item overlap) of the best passage for each pair above the threshold."""
    unknown = len(vocabulary)
    get = vocabulary.get
    tokens = [np.fromiter((get(t, unknown) for t in terms_of(text)), np.int64) for text in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    tokens = np.concatenate([*tokens, np.zeros(0, np.int64)])
    for index in indexes:
        best: dict[tuple[int, int], tuple] = {}
        for d, k, score, a, b in index.search(tokens, starts, threshold):
            ids = tokens[a:b].tolist()
            question, answer, whole = map(shingles, index.parts[k])
            sizes = {len(x) for part in (question, answer, whole) for x in part}
            held = [{tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n in sizes else set() for n in range(SHINGLE + 1)]
            row = (_share(whole, held), score, _share(question, held), _share(answer, held))
            best[d, k] = max(best.get((d, k), row), row)
        for (d, k), (whole, score, question, answer) in best.items():
            yield d, index.items[k], score, question, answer, whole


def _parts(items: DataFrame, part_chars: int):
    """A broadcast (vocabulary, indexes) for each part of the items; frequencies and lengths are those of all items."""
    given = {"question", "answer"} <= set(items.columns)
    items = items.select("item_id", "text", *(["question", "answer"] if given else [])).where("text is not null")
    total, chars, length = items.agg(F.count("*"), F.sum(F.length("text")), F.avg(F.regexp_count("text", F.lit("\\S+")))).first()
    parts = max(1, math.ceil((chars or 0) / part_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")

    def spread(batches):
        for batch in batches:
            rows = [(p, t) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["part", "term"])

    frequency = None
    if parts > 1:
        frequency = map_texts(items.select(part.alias("part"), "text"), spread, "part int, term string").groupBy("term").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"))
        frequency = keep(frequency, "item-terms")
    for k in range(parts):
        rows = []
        for r in items.where(part == k).collect():  # about part_chars characters
            question, answer = (r.question, r.answer) if given else split_item(r.text)
            rows.append((r.item_id, terms_of(r.text), terms_of(question), terms_of(answer)))
        rows = [r for r in rows if r[1]]
        if frequency is None:
            counts = Counter(t for r in rows for t in set(r[1]))
        else:
            counts = {r.term: r.n for r in frequency.where(F.array_contains("parts", k)).collect()}
        yield items.sparkSession.sparkContext.broadcast(build(rows, counts, total, length or 1.0))


def _verified(question: float, answer: float, whole: float, overlap: float) -> bool:
    return whole >= overlap or min(question, answer) >= overlap


def retrieve(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap, verified) of every pair at or above ``threshold``.

    A hit is verified if one passage holds ``overlap`` of the item's shingles, or of the question's and of the answer's.
    """
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, item_overlap double, verified boolean"
    found = None
    for shared in _parts(items, part_chars):

        def work(batches, shared=shared):
            vocabulary, indexes = shared.value
            for batch in batches:
                hits = []
                for i in range(0, batch.num_rows, 512):
                    ids, texts = batch.column(0).slice(i, 512).to_pylist(), batch.column(1).slice(i, 512).to_pylist()
                    for d, item, score, question, answer, whole in _find(indexes, vocabulary, texts, threshold):
                        hits.append((ids[d], item, score, question, answer, whole, _verified(question, answer, whole, overlap)))
                columns = zip(*hits) if hits else [[]] * 7
                kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        hits = map_texts(docs.select("doc_id", "text"), work, schema)
        found = hits if found is None else found.union(hits)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` without a verified hit; no shuffle."""
    for shared in _parts(items, part_chars):

        def make(shared=shared):
            vocabulary, indexes = shared.value

            def mask(texts):
                kept = [True] * len(texts)
                for d, _, _, question, answer, whole in _find(indexes, vocabulary, texts, threshold):
                    kept[d] &= not _verified(question, answer, whole, overlap)
                return kept

            return mask

        docs = filter_texts(docs, make)
    return docs
