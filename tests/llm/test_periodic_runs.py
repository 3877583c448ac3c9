"""Periodic runs against a search of all lags and stretches."""

import random
import time

import numpy as np
import pytest

from sheetwise.llm import periodic_runs, queries
from tests.llm import brute

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id bigint, text string, start string, runs string, words string"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (5, "a b " * 4 + "c"), (5, "a b " * 4 + "c"), (None, "x y z " * 5), (None, None),
    (6, "a a a a a b " * 5), (7, "é ü " * 6 + "\x1f" * 3), (8, "a a a a a"), (9, "a a a a a a"), (10, "a b a b a b a"), (11, "p q p q p q p q x " * 4),
]


def got(df):
    return sorted((tuple(r) for r in periodic_runs.digest(df).select(*COLUMNS).collect()), key=repr)


def test_random_rows_of_words():
    rnd = random.Random(7)
    for _ in range(1500):
        words = []
        for _ in range(rnd.randint(0, 9)):
            words += [rnd.randrange(rnd.choice((1, 2, 3, 6))) for _ in range(rnd.randint(1, 14))] * rnd.randint(1, 7)
            del words[len(words) - rnd.randint(0, 3) :]
        assert periodic_runs.find_runs(np.array(words, np.int64)) == brute.runs(words)


def test_classes_cover_every_lag():
    at = 1
    for lo, hi, k in periodic_runs.classes(10_000):
        assert lo == at and 2 * hi <= k <= max(3 * lo, 6 - lo)
        at = hi + 1
    assert 4 * at > 10_000


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001")
    plain = sorted((brute.periodic(*r) for r in rows), key=repr)
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr) == plain
    assert sum(r[1] for r in plain) > 10


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    assert got(periodic_runs.periodic_runs(docs, periodic_runs.stretched)) == sorted((brute.periodic(*r) for r in rows), key=repr)


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "say ha ha ha ha ha ha now " + "left right " * 5 + "stop")], "doc_id bigint, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1), (8, 10, 2)] and tuple(row.longest) == (8, 10, 2)
    assert row.collapsed == "say ha now left right stop"


@pytest.mark.parametrize("text", ["a " * 400_000, "a b c d e f g " * 50_000, "w" * 3_000_000, " ".join(str(i % 60_000) for i in range(300_000)), "ab" * 9 + " " * 2_000_000])
def test_long_texts(text):
    begin = time.perf_counter()
    words = text.encode().split()
    runs = periodic_runs.find_runs(periodic_runs.numbered(words))
    assert len(runs) == (len(words) > 1) and time.perf_counter() - begin < 20
