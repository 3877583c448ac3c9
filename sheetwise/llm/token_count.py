"""Exact token counts at every prefix of a text, by dynamic programming.

The tokenizer cuts a text into pieces before it applies its merges, so the count of a prefix is that
of the pieces before the one that it cuts, plus that of the piece cut short. Inside a piece a table
is filled from left to right: the last token of a prefix is the one that can stand behind the last
token of the rest, in the order of the merges, so each entry follows from an earlier one. A piece cut
short closes with a token of its own kind (the end of a word), found from the same table.

Truncation and budget questions are then answered from the table: nothing is encoded again, and the
work grows with the text's length, spaces or none.

Defined results: a null text is empty and has no tokens; an empty table gives no rows; repeated rows
keep a row each; extra columns are ignored. A cut between a character and marks that the tokenizer
composes with it is no prefix of its own: it counts as the cut before that character. Very long texts
and pieces take time and memory in proportion to their length.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
# Letters that stay letters, and single ones, in lower case and composed form; and marks that no letter follows.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
_CACHE = 300_000
_LONGEST_CACHED = 64
_NEVER = 1 << 40

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, counts array<int>"


@cache
def _joins_back() -> frozenset[str]:
    """Characters without a combining class that still compose with the one before them."""
    found = {chr(c) for a, b in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(a, b)}  # parts of Hangul syllables
    for c in range(0xA0, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and not unicodedata.combining(x := chr(int(parts[1], 16))):
            found.add(x)
    return frozenset(found)


class Merges:
    """The merges of a vocabulary, with the count of every prefix of a piece.

    Two tokens can stand side by side if no merge across their border comes first: for every symbol that
    ends the left one at some time and every symbol that starts the right one, the merge of both (if there
    is one) comes after the left symbol was merged away, or with or after the right one (of equal merges
    the leftmost is done first). A row of tokens is an encoding if that holds for each pair of neighbours.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.rank, self.made = {}, {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            whole = vocabulary[a + b]
            left, right = vocabulary[a], vocabulary[b]
            if whole in self.made:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[left, right], self.made[whole] = k, (left, right, k)
        # Every start of a token, with the inner and the final tokens that end there, the longest first.
        inner = {t: k for t, k in vocabulary.items() if not t.endswith(suffix)}
        final = {t.removesuffix(suffix): k for t, k in vocabulary.items() if t.endswith(suffix)}
        self.starts: dict[str, tuple[tuple, tuple]] = {"": ((), ())}
        for start in sorted({t[:i] for t in (*inner, *final) for i in range(1, len(t) + 1)}, key=len):
            end = start[1:]
            while end not in self.starts:
                end = end[1:]
            self.starts[start] = tuple(((len(start), known[start]), *old) if start in known else old for known, old in zip((inner, final), self.starts[end]))
        self._fit: dict[int, bool] = {}
        self._edge: dict[tuple[int, int], list] = {}

    def _edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one end of a token as it grows, each with the merge that takes it away."""
        found = self._edge.get((token, side))
        if found is None:
            found, t = [(token, _NEVER)], token
            while t in self.made:
                gone = self.made[t][2]
                t = self.made[t][side]
                found.append((t, gone))
            self._edge[token, side] = found
        return found

    def fit(self, shifted: int, right: int) -> bool:
        rank, left = self.rank.get, shifted >> 20
        fits = not any((r := rank((a, b))) is not None and r < a_gone and r <= b_gone for a, a_gone in self._edges(left, 1) for b, b_gone in self._edges(right, 0))
        if len(self._fit) >= 1_000_000:
            self._fit.clear()
        self._fit[shifted | right] = fits
        return fits

    def counts(self, piece: str) -> list[int]:
        """Tokens of ``piece[:i]``, taken as a piece of its own, for i from 1."""
        starts, known, fit = self.starts.get, self._fit.get, self.fit
        last, count, out = [-1], [0], []  # last tokens are shifted, ready to make a key
        close, go_on, counted = out.append, last.append, count.append
        j = 0
        for i in range(1, len(piece) + 1):
            # The longest start of a token that ends here begins where the one before did, or later.
            while (found := starts(piece[j:i])) is None:
                j += 1
            inner, final = found
            for size, token in final:
                k = i - size
                if not k or ((ok := known(last[k] | token)) or ok is None and fit(last[k], token)):
                    close(count[k] + 1)
                    break
            for size, token in inner:
                k = i - size
                if not k or ((ok := known(last[k] | token)) or ok is None and fit(last[k], token)):
                    go_on(token << 20)
                    counted(count[k] + 1)
                    break
        return out


class Counter(dict):
    """Counts at every prefix of a chunk between spaces, as bytes of 32-bit numbers; the last stands for the space behind it.

    Chunks of the present and of the former _CACHE are held.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.symbols, self.former = {}, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.former.get(chunk)
        if found is None:
            found = self._found(chunk)
        if len(chunk) <= _LONGEST_CACHED:
            if len(self) >= _CACHE:
                self.former = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def _found(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):
            low = chunk.lower()
            if low != chunk:
                return self[low]
            counts = self._word(chunk)
        elif m := _MARKED.fullmatch(chunk):  # letters, then marks: a piece each
            letters, marks = np.frombuffer(self[m[1]], np.int32), np.frombuffer(self[m[2]], np.int32)
            return np.concatenate([letters[:-1], marks + letters[-1]]).tobytes()
        else:
            counts = self._chunk(chunk)
        return np.array([*counts, counts[-1] if counts else 0], np.int32).tobytes()

    def _cuts(self, piece: str, text: str) -> list[int]:
        """Tokens at each code point of ``text``, whose bytes are the symbols of ``piece``."""
        counts = self.merges.counts(piece)
        if len(piece) == len(text):
            return counts
        return [counts[i - 1] for i in accumulate(len(c.encode()) for c in text)]

    def _word(self, low: str) -> list[int]:
        if low.isascii():
            return self.merges.counts(low)
        symbols = self.symbols
        for c in low:
            if c not in symbols:
                symbols[c] = self.cut(c)[0][0]
        return self._cuts("".join(map(symbols.__getitem__, low)), low)

    def _pieces(self, normal: str) -> list[int]:
        """Tokens of ``normal[:k]``, k from 0."""
        out = [0]
        for piece, (a, b) in self.cut(normal):
            out += [out[-1]] * (a + 1 - len(out))  # white space
            before = out[-1]
            counts = self._cuts(piece, normal[a:b])
            if piece[0] == "'" and b - a > 1 and normal[a + 1].isalpha():
                # Cut short, an ending such as 'll is a mark and letters.
                rest = self.merges.counts(piece[1:-1])
                counts = [counts[0], *(counts[0] + x for x in rest), counts[-1]]
            out += [before + x for x in counts]
        return out + [out[-1]] * (len(normal) + 1 - len(out))

    def _chunk(self, chunk: str) -> list[int]:
        """Tokens of ``chunk[:k]``, k from 1."""
        if chunk.isascii() and "<|" not in chunk:
            return self._pieces(chunk.lower())[1:]
        found, before = [], 0
        # A special string cut short is plain text behind the text before it; whole, it is one token.
        for k, part in enumerate(parts := self.special.split(chunk)):
            if k % 2:
                continue
            special = parts[k + 1] if k + 1 < len(parts) else ""
            own = self._plain(part + special[:-1])
            found += [before + x for x in own]
            if special:
                before += (own[len(part) - 1] if part else 0) + 1
                found.append(before)
        return found

    def _plain(self, text: str) -> list[int]:
        normal = self.normal(text)
        if len(normal) == len(text) and unicodedata.is_normalized("NFC", text) and not any(map(str.isspace, text)):
            return self._pieces(normal)[1:]
        # Cuts at the borders of composed characters; what is composed may change its length.
        starts = [k for k, c in enumerate(text) if not (unicodedata.combining(c) or c in _joins_back())]
        starts = [0, *(k for k in starts if k)]
        parts = [self.normal(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)])]
        joined = "".join(parts)
        if re.sub(" +", " ", joined) != normal:  # composed by other rules: one border, at the end
            starts, parts, joined = [0], [normal], normal
        counts, out, at = self._pieces(joined), [], 0
        for a, b, part in zip(starts, [*starts[1:], len(text)], parts):
            out += [counts[at]] * (b - a - 1)
            at += len(part)
            out.append(counts[at])
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]``, k from 1 to the length of the text."""
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = [self[c] for c in chunks]
        inside = np.frombuffer(b"".join(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.cumsum(lengths)
        totals = inside[ends - 1]
        return (inside + np.repeat(np.cumsum(totals) - totals, lengths))[:-1]


def longest(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens; inside a word a longer cut may have fewer tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _counter(vocabulary: str) -> Counter:
    """One a worker: its chunks serve the tasks that follow."""
    counter = Counter(_path(vocabulary))
    gc.freeze()  # the tables stay; collections needn't look at them
    return counter


def _tables(batches, vocabulary: str, rows: int = 256):
    """Ids, texts and prefix tables, a few documents at a time."""
    counter = _counter(vocabulary)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield part.column(0), texts, [counter.prefixes(t) for t in texts]


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """SCHEMA: bytes, tokens, and the count at every prefix of each document, from its first code point on."""

    def work(batches):
        for ids, texts, tables in _tables(batches, vocabulary):
            ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*tables, np.zeros(0, np.int32)]).astype(np.int32), pa.int32()))
            totals = [int(t[-1]) if len(t) else 0 for t in tables]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), counts], names=["doc_id", "n_bytes", "n_tokens", "counts"])

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def fitting(stored: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``fits_chars`` to the rows of ``prefix_counts``: the longest prefix of at most ``limit`` tokens, from the stored counts alone."""
    over = F.array_position(F.transform(F.reverse("counts"), lambda n: n <= limit), F.lit(True)).cast("long")
    return stored.withColumn("fits_chars", F.when(over > 0, F.size("counts") + 1 - over).otherwise(F.lit(0).cast("long")))


def budget_answers(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each text, whether they exceed ``limit``, and the longest prefix within it, in code points.

    All three are read from the document's prefix table, which lives only while its row is answered.
    """

    def work(batches):
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        for ids, texts, tables in _tables(batches, vocabulary):
            rows = []
            for text, counts in zip(texts, tables):
                n = int(counts[-1]) if len(counts) else 0
                rows.append((len(text.encode()), n, n > limit, longest(counts, limit)))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return map_texts(docs.select("doc_id", "text"), work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint")
