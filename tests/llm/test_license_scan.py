"""License scans against their SQL and a plain search of phrases."""

import random
import time

import duckdb
import pytest

from sheetwise.llm import license_scan, queries
from tests.llm import brute

BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
COLUMNS = (*BASE, "labels", "score")
SCHEMA = "doc_id bigint, text string, words string, template string, h1 string, spans string"
NOTICE = dict(license_scan.NOTICES)
ODD = [
    (1, None), (2, ""), (3, " \t\n.,"), (4, "MIT License, mit-license; mitlicense MIT\nLICENSE"), (4, "MIT License, mit-license; mitlicense MIT\nLICENSE"), (None, "the general public license"),
    (None, None), (5, "general public general public license license"), (6, "é mit license ü İ"), (7, NOTICE["bsd"]), (8, "x " + NOTICE["isc"].replace("any purpose", "any good or bad purpose") + " y"),
    (9, " ".join(NOTICE["mpl"].split()[:8])), (10, NOTICE["unlicense"] + " and " + NOTICE["unlicense"]), (11, "apache\x00license\x7fapache license"), (12, "Licensed under CC BY-NC 3.0."),
]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.sql(license_scan.ORACLE).select(*COLUMNS).fetchall(), key=repr)


def test_base_of_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    plain = sorted(((d, *brute.licenses(t)) for d, t in rows), key=repr)
    assert got(queries.op11_license_scans(spark, "/root/testdata/sf0.01"), *BASE) == plain and sum(r[2] for r in plain) > 20


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    out = license_scan.digest(license_scan.find_licenses(docs))
    assert got(out, *COLUMNS) == by_sql(rows)
    assert got(out, *BASE) == sorted(((d, *brute.licenses(t)) for d, t in rows), key=repr)


def test_labels_of_the_method(spark):
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in ODD], SCHEMA)
    labels = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.digest(license_scan.find_licenses(docs)).collect()}
    assert labels[7] == ("bsd", 1.0) and labels[8][0] == "isc" and labels[10] == ("unlicense", 1.0) and labels[12][0] == "cc-by-nc"
    assert labels[9] == ("", 0.0)  # eight words of a notice are too few


def test_noisy_notices_against_sql(spark):
    rnd, rows = random.Random(5), []
    for k in range(150):
        words = " ".join(t for _, t in rnd.sample(license_scan.NOTICES, rnd.randint(1, 3))).split()
        for _ in range(rnd.randint(0, 25)):
            i = rnd.randrange(len(words))
            words[i : i + rnd.randint(0, 3)] = rnd.choices(["the", "of", "license", "software", "odd"], k=rnd.randint(0, 3))
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = got(license_scan.digest(license_scan.find_licenses(docs)), *COLUMNS)
    assert [r[:-1] for r in out] == [r[:-1] for r in by_sql(rows)] and [round(r[-1], 9) for r in out] == [round(r[-1], 9) for r in by_sql(rows)]
    assert len({r[6] for r in out}) > 10


def test_parts_of_templates_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in ODD], SCHEMA)
    whole = got(license_scan.digest(license_scan.find_licenses(docs)), *COLUMNS)
    monkeypatch.setattr(license_scan, "MAX_TEMPLATE_WORDS", 60)
    assert len(license_scan._parts(license_scan.templates(spark))) > 3
    assert got(license_scan.digest(license_scan.find_licenses(docs)), *COLUMNS) == whole


def test_own_templates_and_spans(spark):
    known = license_scan.templates(spark, [("house", "house rules")], [("long", "one two three four five six")])
    docs = spark.createDataFrame([(1, "House rules: one two three four five six, house rules")], "doc_id bigint, text string")
    spans = license_scan.find_licenses(docs, known).first().spans
    assert [(s.start, s.end, s.label, s.base) for s in spans] == [(0, 2, "house", True), (2, 8, "long", False), (8, 10, "house", True)]


def test_plan_is_native_and_makes_grams_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = license_scan.find_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("FileScan") == 1 and "BroadcastNestedLoop" not in plan
    assert not any("Filter" in line and "coalesce(text" in line for line in plan.splitlines())  # documents' texts can be null, templates' not


@pytest.mark.parametrize("text", ["mit license " * 100_000, "w" * 2_000_000, "zz " * 300_000, "." * 2_000_000, (NOTICE["bsd"] + " ") * 2_000])
def test_long_texts(spark, text):
    begin = time.perf_counter()
    row = license_scan.digest(license_scan.find_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert (row.n_words, row.n_base) == brute.licenses(text)[:2] and time.perf_counter() - begin < 60
