"""Language identification by words first, with backoff to shorter character n-grams.

Training counts words and character n-grams by language over a bounded sample of labelled documents
(about ``per_language`` documents a language, chosen by a hash of the id, whole texts). Prediction sums,
over the words of a text, the log frequency of the word in each language; a word that no language
knows is scored by the mean over its longest n-grams that some language knows.

The model itself is bounded too: of the sample it holds the MAX_LANGUAGES most frequent languages (others
are never predicted) and, for each language and kind, its share of MAX_ENTRIES, the most frequent first
(rarer words are scored by their n-grams, and rarer n-grams by shorter ones); words of more than
MAX_LENGTH letters are scored by n-grams alone. These bounds don't depend on the size of the table.

Defined results: a letter is a character of a Unicode letter category. A null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing is labelled. Equal scores go to the language that sorts first. Rows that repeat keep a row
each; an empty table gives no rows; extra columns are ignored; a very long text is read in steps of whole words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import filter_texts, map_texts

UNKNOWN = "und"
GRAMS = (5, 4, 3, 2, 1)
MAX_LANGUAGES = 200
MAX_ENTRIES = 400_000
MAX_LENGTH = 200
_CACHE = 200_000


_WORD = re.compile(r"[^\W\d_]+")


@cache
def _numerals() -> dict[int, str]:
    """Spaces for numerals such as ½ and Ⅷ, which \\w holds besides digits but which are no letters."""
    return {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}


@cache
def _numeral_set() -> frozenset[str]:
    return frozenset(map(chr, _numerals()))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and not _numeral_set().isdisjoint(text):
        text = text.translate(_numerals())
    return _WORD.findall(text)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches):
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, counts in words.items():
            grams = {n: Counter() for n in GRAMS}
            for word, c in counts.items():
                for n in GRAMS:
                    for g in grams_of(word, n):
                        grams[n][g] += c
            rows += [(lang, 0, w, c) for w, c in counts.items()]
            rows += [(lang, n, g, c) for n in GRAMS for g, c in grams[n].items()]
        columns = zip(*rows) if rows else [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "kind", "gram", "n"])


class Model:
    """Log frequencies by language: ``tables[0]`` of words, ``tables[n]`` of n-grams."""

    def __init__(self, languages: list[str], rows: list[tuple[str, int, str, int]], smoothing: float = 0.5):
        self.languages = sorted(languages)
        at = {x: k for k, x in enumerate(self.languages)}
        self.tables: dict[int, dict[str, tuple[float, ...]]] = {}
        for kind in (0, *GRAMS):
            counts: dict[str, np.ndarray] = {}
            for lang, k, gram, n in rows:
                if k == kind:
                    counts.setdefault(gram, np.zeros(len(at)))[at[lang]] += n
            total = sum(counts.values(), np.zeros(len(at))) + smoothing * (len(counts) + 1)
            self.tables[kind] = {g: tuple(np.log((c + smoothing) / total).tolist()) for g, c in counts.items()}

    def word(self, word: str) -> list[float]:
        """Log frequency in each language, relative to the best. Languages are few: plain floats beat arrays."""
        found = self.tables[0].get(word)
        if found is None:
            for n in GRAMS:
                known = [v for v in map(self.tables[n].get, grams_of(word, n)) if v is not None]
                if known:
                    found = [sum(x) / len(known) for x in zip(*known)]
                    break
            else:
                return [0.0] * len(self.languages)
        best = max(found)
        return [x - best for x in found]


class _Rows(dict):
    """Row of the score matrix for each word; holds at most _CACHE words."""

    def __init__(self, model: Model):
        self.model, self.matrix = model, np.zeros((_CACHE, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.matrix[row] = self.model.word(word)
        return row


def predict(model: Model, rows: _Rows, text: str | None) -> tuple[str, float]:
    words = words_of(text)
    if not words or not model.languages:
        return UNKNOWN, 0.0
    total, step = np.zeros(len(model.languages)), 50_000
    for i in range(0, len(words), step):
        part = words[i : i + step]
        if len(rows) + len(part) > _CACHE:
            rows.clear()
        total += rows.matrix[np.fromiter(map(rows.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
    best = int(np.argmax(total))
    return model.languages[best], min(1.0, 1.0 / float(np.exp(total - total[best]).sum()))


def fit(labelled: DataFrame, per_language: int = 4000) -> Model:
    """Fit on ``labelled`` (doc_id, lang, text); rows without a language are ignored.

    The sample takes about ``per_language`` documents of each of the MAX_LANGUAGES most frequent
    languages; at most MAX_ENTRIES words and n-grams, the most frequent of each language and kind,
    reach the driver. Both bounds are independent of the table's size.
    """
    labelled = labelled.where("lang is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Model([], [])
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(F.col("lang").isin(*(x.lang for x in sizes))).where(draw < share[F.col("lang")])
    counts = map_texts(sample.select("lang", "text"), _count, "lang string, kind int, gram string, n bigint").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    most = MAX_ENTRIES // (len(sizes) * (1 + len(GRAMS)))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))
    rows = counts.where(F.length("gram") <= MAX_LENGTH).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "kind", "gram", "n").collect()
    return Model(sorted({x.lang for x in rows}), [tuple(x) for x in rows])


def _loader(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))

    def load():
        known = Model.__new__(Model)
        known.languages, known.tables = shared.value
        return known, _Rows(known)

    return load


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; the score is the posterior at equal priors."""
    load = _loader(docs, model)

    def work(batches):
        known, rows = load()
        for batch in batches:
            found = [predict(known, rows, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more."""
    load = _loader(docs, model)

    def make():
        known, rows = load()
        return lambda texts: [lang != UNKNOWN and score >= least for lang, score in (predict(known, rows, t) for t in texts)]

    return filter_texts(docs, make)


def held_out() -> F.Column:
    """True for a fifth of the ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
