"""Quality rules from repetition coverage.

Words are hashed, and n-grams of several lengths are compared by polynomial rolling hashes in numpy.
The measure for a length is the share of word characters that lie inside n-grams occurring twice or
more; duplicated lines are measured alike.

Defined results: a null text has no words and fails; an empty table gives no rows; repeated rows
keep a row each; extra columns are ignored. A share exactly at its limit passes. A very long text is measured whole, in time
and memory in proportion to its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheetwise.llm.common import map_texts

#: Largest share of characters in duplicated n-grams, by n. The published limits for web text.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
MIN_WORDS = 10
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, dup_line_share double, dup_ngram_share double, kept boolean"
)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words; arithmetic modulo 2**64."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(_MULTIPLIER)
        out += hashes[k : k + len(out)]
    return out


def covered_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside an ``n``-word window that occurs twice or more."""
    mask = np.zeros(len(hashes), bool)
    windows = rolling(hashes, n)
    if len(windows) < 2:
        return mask
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return mask
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _code_points(words: list[bytes], text: str, data: bytes) -> np.ndarray:
    if len(text) == len(data):
        return np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((len(w.decode()) for w in words), np.int64, len(words))


def measure(text: str | None) -> tuple:
    """The columns of SCHEMA after doc_id."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: at the ASCII white space
    lengths = _code_points(words, text, data)
    total = int(lengths.sum())
    symbols = len(_SYMBOLS.findall(text))
    seen, dup_lines, dup_chars, line_chars = set(), 0, 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            size = len(line)
            line_chars += size
            if line in seen:
                dup_lines += 1
                dup_chars += size
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mask = covered_words(hashes, 5)
    repeats = int(mask.sum())
    failed = len(words) < MIN_WORDS or 100 * repeats > 20 * len(words)
    line_share = dup_chars / line_chars if line_chars else 0.0
    worst, over = 0.0, False
    for n, most in MAX_NGRAM_SHARE.items():
        if n > 5 and mask.any():  # a longer window that repeats holds only words of repeated shorter ones
            mask = covered_words(hashes, n)
        share = float(lengths[mask].sum()) / total if total else 0.0
        worst = max(worst, share)
        over |= share > most
    return len(words), total, symbols, dup_lines, repeats, failed, line_share, worst, not (failed or over or line_share > MAX_LINE_SHARE)


def _measure(batches):
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        columns = zip(*rows) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each document; one pass, no shuffle."""
    return map_texts(docs.select("doc_id", "text"), _measure, SCHEMA)
