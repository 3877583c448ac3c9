"""Logs appended once and summed by what is new, rules of stored answers, reports of cells, decks of templates."""

import json
import os
import shutil
import tempfile

import pytest

from sheetwise.operators import batch, cells, tiles
from sheetwise.plans import pipelines
from sheetwise.sources import files

LOG = "call_id long, timestamp string, modelo string, total_tokens string, prompt_tokens string, completion_tokens string, latencia_ms string, custo_usd string"


def calls(spark, *ids):
    return spark.createDataFrame([(k, "2026-07-01T00:00:00", "m", "n/a" if k % 5 == 0 else str(100 + k), "1", "2", str(10.5 * k), "x" if k % 7 == 0 else f"0.{k:06d}") for k in ids], LOG)


def test_a_repeated_append_leaves_the_log_as_it_was(spark):
    log = tempfile.mkdtemp(prefix="spark-")
    assert files.append_log(calls(spark, 1, 2, 3), log, "a") and not files.append_log(calls(spark, 1, 2, 3, 4), log, "a")
    assert files.append_log(calls(spark, 5), log, "b") and files.committed(spark, log) == {"a", "b"}
    assert sorted((r.batch, r.latencia_ms) for r in files.read_batches(spark, log, ["a", "b"]).collect()) == [("a", "10.5"), ("a", "21.0"), ("a", "31.5"), ("b", "52.5")]
    os.remove(f"{log}/batch=b/_SUCCESS")  # as a failed job leaves it
    assert files.committed(spark, log) == {"a"} and files.append_log(calls(spark, 6), log, "b")
    assert [r.latencia_ms for r in files.read_batches(spark, log, ["b"]).collect()] == ["63.0"]
    with pytest.raises(ValueError):
        files.append_log(calls(spark, 1), log, "../x")


def test_a_summary_reads_new_batches_alone(spark):
    log, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-") + "/sums"
    assert tuple(batch.cost_total(files.summed_increments(spark, log, state)).first()) == tuple(batch.cost_summary(calls(spark, 1).where("false")).first())
    files.append_log(calls(spark, *range(1, 40)), log, "one")
    files.summed_increments(spark, log, state)
    shutil.rmtree(f"{log}/batch=one")  # it isn't looked at again
    files.append_log(calls(spark, *range(40, 90)), log, "two")
    got = batch.cost_total(files.summed_increments(spark, log, state)).first()
    assert tuple(got) == tuple(batch.cost_summary(calls(spark, *range(1, 90))).first()) and got.calls > 30


FIELD = {"value": "v", "evidence": "e", "confidence": 0.5}
GOOD = {f: FIELD for f in batch.FIELDS} | {"cited_standards": [{"standard": "ISO 1", "evidence": "x"}]}


@pytest.mark.parametrize(
    "change, rule",
    [({}, []), ({"component": None}, ["component: missing"]), ({"component": FIELD | {"confidence": None}}, ["component: confidence"]), ({"material_family": FIELD | {"confidence": 1.01}}, ["material_family: confidence"]),
     ({"compressor_series": FIELD | {"confidence": -0.1}}, ["compressor_series: confidence"]), ({"document_type": FIELD | {"evidence": "x" * 151}}, ["document_type: evidence too long"]),
     ({"document_type": {"value": "v"}}, ["document_type: confidence"]), ({"cited_standards": None}, ["cited_standards: missing"]), ({"cited_standards": GOOD["cited_standards"] * 2}, ["cited_standards: repeated"]),
     ({"cited_standards": [{"standard": "ISO 1", "evidence": "x" * 151}]}, ["cited_standards: evidence too long"]), (None, ["malformed"])],
)
def test_each_rule_of_an_answer(spark, change, rule):
    text = "{" if change is None else json.dumps(GOOD | change)
    assert batch.response_ingest(spark.createDataFrame([(1, text)], "doc_id long, response string")).first().violations == rule


def test_kinds_in_one_scan(spark):
    answers = {
        "classification": ['{"classificacao":"a","justificativa":"b"}', '{"classificacao":"a"}'], "standards": ['{"lista_normas":["a","a"],"justificativas":["b"]}'],
        "missing_standards": ['{"normas_sugeridas":[],"reasoning":"r","confianca":2}'], "difference": ['{"parecer_geral":"o","analise_faltantes":[{"norma":"x"}],"analise_extras":[],"conformidade_percentual":1}', "{"],
    }
    rows = [(10 * i + j, kind, t) for i, (kind, own) in enumerate(answers.items()) for j, t in enumerate(own)] + [(99, "other", "{}")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, response string")
    whole = {r.doc_id: r.violations for r in batch.kinds_ingest(df).collect()}
    for kind in answers:
        for r in batch.schema_ingest(df.where(df.kind == kind), kind).collect():
            assert whole[r.doc_id] == r.violations
    assert whole[0] == [] and whole[99] == ["unknown kind"] and whole[10] == ["lista_normas: unequal length", "lista_normas: repeated"]


def test_report_of_a_page(spark):
    unique = spark.createDataFrame([(1, "CELL-01-0001", 11, True, 0.0, 0.0, 20.0, 10.0), (1, "CELL-01-0002", 12, False, 20.0, 0.0, 40.0, 10.0), (2, "CELL-02-0001", 21, True, 0.0, 0.0, 20.0, 10.0)], "page_id long, cell_id string, cell_key long, is_first boolean, x0 double, y0 double, x1 double, y1 double")
    scores = spark.createDataFrame([(11, r, t, s) for r in cells.REPRESENTATIONS for t, s in (("p", 0.9), ("q", 0.3))] + [(12, "gray", "q", 0.2)], "cell_id long, representation string, template string, score double")
    matches = spark.createDataFrame([(1, "p", 0.8, 1.0, 5.0, 2.0, 9.0, 6.0), (1, "q", 0.77777, 1.0, 100.0, 2.0, 110.0, 6.0), (3, "q", 0.5, 1.0, 1.0, 2.0, 3.0, 6.0)], "page_id long, symbol string, score double, scale double, x0 double, y0 double, x1 double, y1 double")
    got = {r.page_id: json.loads(r.json) for r in pipelines.gdt_json(pipelines.gdt_report(unique, scores, matches)).collect()}
    assert {p: (x["total_cells"], x["total_classifications"], x["accepted_count"], x["classes"]) for p, x in got.items()} == {1: (2, 2, 1, [{"template": "p", "n": 1}]), 2: (1, 0, 0, []), 3: (0, 0, 0, [])}
    assert [(m["symbol"], m["score"]) for m in got[1]["fallback_matches"]] == [("q", 0.7778)] and len(got[3]["fallback_matches"]) == 1
    assert [(c["cell_id"], c["best"], c["accepted"], c["agreement"]) for c in got[1]["classifications"]] == [("CELL-01-0001", "p", True, True), ("CELL-01-0002", "q", False, True)]


def test_decks_of_templates_give_the_same(spark, monkeypatch):
    c = spark.createDataFrame([(k, r, [float(k), 1.0, 2.0, float(k * k % 7)]) for k in range(20) for r in ("gray", "edges")], "cell_id long, representation string, vec array<double>")
    t = spark.createDataFrame([(f"t{k}", r, [1.0, float(k), 3.0, 4.0]) for k in range(9) for r in ("gray", "edges")], "template string, representation string, vec array<double>")
    show = lambda: sorted((r.cell_id, r.representation, r.template, round(r.score, 9)) for r in cells.template_correlation(c, t).collect())
    whole = show()
    monkeypatch.setattr(cells, "MAX_BROADCAST", 4)
    assert len(whole) == 20 * 2 * 9 and show() == whole


def test_highlight_boxes(spark):
    r = spark.createDataFrame([(1, 1, 7, 0, 0, 1, 2)], "pair_id long, page int, region long, x0 int, y0 int, x1 int, y1 int")
    assert tuple(tiles.highlight_boxes(r, 16, 3000, 2000).first())[3:] == (0, 0, 40, 56)
    assert tuple(tiles.highlight_boxes(r, 16, 30, 40).first())[3:] == (0, 0, 30, 40)
