"""Alignment of two tokenizers against their libraries and a plain search of overlaps."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sheetwise.llm import alignment, queries
from tests.llm import brute

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SCHEMA = "doc_id bigint, text string, n_a string, pair string, block string"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "the dog"), (None, None), (6, "a▁b"),
    (7, "<|endoftext|> <s> </s> <0x41> <unk>"), (8, "😀👍🏽 ️ é 中文字 한글"), (9, "  two  spaces  "), (10, "\x00\x01 \x7f"), (11, "x" * 3000), (12, " " * 9000), (13, "don't 12½\r\n 　"),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    byte = {c: k for k, c in enumerate(_byte_letters())}
    spell_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(t, add_special_tokens=False).ids, spell_a, b.encode, spell_b


def _byte_letters():
    other = 255
    for k in range(256):
        if chr(k).isprintable() and k != 32 and k != 173:
            yield chr(k)
        else:
            other += 1
            yield chr(other)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(queries.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001")) == sorted(brute.alignment(rows, *libraries), key=repr)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, libraries, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    plain = sorted(brute.alignment(rows, *libraries), key=repr)
    assert got(alignment.totals(docs)) == plain
    assert not rows or sum(r[1] == 0 for r in plain) == 4  # null twice, empty, and a text with the model's sign for a space


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = got(alignment.totals(docs))
    work, parts = alignment.map_texts, alignment._parts
    monkeypatch.setattr(alignment, "map_texts", lambda df, f, schema: work(df.repartition(5), f, schema) if "text" in df.columns else work(df, f, schema))
    assert got(alignment.totals(docs)) == whole
    small = list(parts(iter([_batch(["a" * 2_000_000, "b", None, "c" * 1_000_000, "d"])])))
    assert [p[1] for p in small] == [["a" * 2_000_000], ["b", None, "c" * 1_000_000, "d"]]


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_encoders_equal_the_libraries(libraries):
    rnd, encoders = random.Random(11), alignment.Encoders(alignment.FIRST, alignment.SECOND)
    pools = ["abc '’sTllLL12½Ⅷ²\n\t\r   　\x0b\x1c\x85", "éñßıİſ中文字あ한글", "<|endoftext|><s></s>[INST]<0x41> ", "👍🏽🇩🇪é̀ᆅ\U0001e900\x00\x01", "   ", "the man of and "]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    for side, encode, lead in zip(encoders.sides, libraries[::2], (" ", "")):
        assert side.encode(texts) == [encode(lead + t) for t in texts]


def test_links_and_groups(spark, libraries):
    row = alignment.alignments(spark.createDataFrame([(1, "unbelievable tokenizers")], "doc_id bigint, text string")).first()
    plain = brute.alignment([(1, "unbelievable tokenizers")], *libraries)[0]
    assert (len(row.a_ids), len(row.b_ids), len(row.links), brute.sha(row.groups)) == (plain[1], plain[2], plain[4], plain[7])
    for side, own in (("a", row.a_ids), ("b", row.b_ids)):
        assert {x[side] for x in row.links} == set(range(len(own)))
    sides = [g.split("|") for g in row.groups.split(";")]
    assert [int(i) for a, _ in sides for i in a.split(",")] == row.a_ids and [int(i) for _, b in sides for i in b.split(",")] == row.b_ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 300_000, "中文" * 100_000, "xY0+/z" * 50_000, "word " * 100_000])
def test_long_texts(text):
    begin = time.perf_counter()
    encoders = alignment.Encoders(alignment.FIRST, alignment.SECOND)
    x = alignment.Aligned(encoders, [text])
    assert len(x.a) and len(x.cuts) and len(x.groups(encoders)[0]) > 1000
    assert time.perf_counter() - begin < 30
