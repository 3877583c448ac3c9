"""Documented examples of the column functions, and property tests of rounding."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwise.functions import text as T
from sheetwise.operators import batch, reports, standards


def values(spark, f, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.y for r in df.select("k", f("x").alias("y")).orderBy("k").collect()]


def test_normalize_text(spark):
    got = values(spark, T.normalize_text, "Connecting Rod", "SINTERED  METAL", "sintered_metal", None, "Diferença\tX")
    assert got == ["connecting rod", "sintered metal", "sinteredmetal", "", "diferenax"]


def test_normalize_standard(spark):
    got = values(spark, T.normalize_standard, "TSS002611", "TSS-002611", "tss 002611", "TSS  002611", "ISO 13849-1", "tss-002611a", "NBR-ISO 9001", " \t", None)
    assert got == ["TSS 002611"] * 4 + ["ISO 13849 1", "TSS 002611a", "NBR ISO 9001", "", ""]


def test_note_number(spark):
    got = values(spark, T.note_number, "NOTE 7: TSS 002611", "7. GEOMETRIC REQUIREMENTS", "ACCORDING TO TSS 002611", "NOTA 3: X", "see notes 12.", None)
    assert got == [7, 7, None, None, 12, None]


def test_split_list(spark):
    got = values(spark, T.split_list, "F, EG, FMF, VEG", "Crankshaft; Connecting Rod", "All", " ;, ", None, "a,a")
    assert got == [["F", "EG", "FMF", "VEG"], ["Crankshaft", "Connecting Rod"], ["All"], [], [], ["a"]]


def test_status_class(spark):
    got = values(spark, T.status_class, "Aprovado com Observação", " aprovado ", "Requer Correção", "Correcao", "outro", None)
    assert got == ["observation", "approved", "correction", "correction", None, None]


def test_report_text(spark):
    assert values(spark, lambda c: T.report_text(F.col(c)), "a<br>**b**<BR/>c") == ["a; b; c"]
    assert values(spark, lambda c: T.bullets(F.col(c)), "a; b ;; c", "one") == [["a", "b", "c"], None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Central (D4 a E7)", [("D", "4", "E", "7")]),
        ("Canto Inferior Direito (A1, B1)", [("A", "1", None, None), ("B", "1", None, None)]),
        ("Vários Quadrantes (F4-F7, C9-E9, B8-D8)", [("F", "4", "F", "7"), ("C", "9", "E", "9"), ("B", "8", "D", "8")]),
        ("Central / Vistas de Detalhe", []),
        ("(F4-F7, C9-E9, B8-D8) A1, 1b", [("F", "4", "F", "7"), ("C", "9", "E", "9"), ("B", "8", "D", "8"), ("A", "1", None, None), ("B", "1", None, None)]),
        (None, []),
    ],
)
def test_zone_groups(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id int, zone_text string")
    got = reports.zone_groups(df, "doc_id").orderBy("group_no").select("row_a", "col_a", "row_b", "col_b").collect()
    assert [tuple(r) for r in got] == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e6, allow_nan=False), min_size=50, max_size=200), st.sampled_from([2, 4, 6]))
def test_fixed_rounds_as_printf(spark, xs, digits):
    xs += [k / 10 ** (digits + 1) * 5 for k in range(200)]
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "k int, x double")
    got = [r.y for r in df.select("k", T.fixed(F.col("x"), digits).alias("y")).orderBy("k").collect()]
    assert got == [f"{x:.{digits}f}" for x in xs]


def test_cost_summary_counts_up_to_the_first_bad_cell(spark):
    rows = [(1, "t", "m", "10", "5", "5", "100", "0.5"), (2, "t", "m", "20", "5", "5", "100", "x"), (3, "t", "m", "30", "5", "5", "", "0.25"), (4, "t", "m", "n/a", "1", "1", "1", "1")]
    df = spark.createDataFrame(rows, "call_id long, timestamp string, modelo string, total_tokens string, prompt_tokens string, completion_tokens string, latencia_ms string, custo_usd string")
    assert tuple(batch.cost_summary(df).first()) == (1, 60, "$0.7500", "100.00")
    assert tuple(batch.cost_summary(df.limit(0)).first()) == (0, 0, "$0.0000", "0.00")


def test_markdown_edges(spark):
    text = "x\n| a | b | a |\n|---|:-:|---|\n| 1 | 2 | 3 | 4 |\n| 5 |\nend"
    df = spark.createDataFrame([(1, text), (2, "no table"), (3, None)], "doc_id int, report string")
    got = {(r.row_no, r.header): r.value for r in reports.markdown_rows(df).collect()}
    assert got == {(1, "a"): "3", (1, "b"): "2", (2, "a"): "", (2, "b"): ""}
    around = {r.doc_id: (r.before, r.after) for r in reports.report_preamble(df).collect()}
    assert around[1] == ("x", "end") and around[2] == ("no table", "")


def test_lookup_cases(spark):
    notes = spark.createDataFrame(
        [(1, "TSS-1", "c", "Process", "All", "Connecting Rod"), (2, "TSS-2", "c", "Process", "EG", "Piston; Connecting Rod"), (3, "TSS-3", "Sintered metal parts", "Material", "F", ""), (4, "", "c", "x", "All", "all")],
        "ord long, standard string, content string, category string, compressor_series string, applicability string",
    )
    parts = spark.createDataFrame([(1, "Connecting Rod", "ISO 1; tss-2"), (2, "Piston", "DIN 5"), (3, "Connecting Rod", "ISO 7")], "ord long, part string, mandatory string")
    drawings = spark.createDataFrame(
        [(1, "Connecting Rod", "F", "sintered_metal"), (2, "Piston", None, None), (3, "connecting rod raw", "EG", "sintered metal"), (4, None, None, None)],
        "drawing_id long, component string, compressor_series string, material_family string",
    )
    n, p = standards.clean_notes(notes), standards.clean_parts(parts)
    got = {(r.drawing_id, r.standard, r.source) for r in standards.applicable_standards(drawings, p, n).collect()}
    assert got == {
        (1, "ISO 7", standards.MATRIX), (1, "TSS 1", standards.COMPONENT), (2, "DIN 5", standards.MATRIX),
        (3, "ISO 7", standards.MATRIX), (3, "TSS 1", standards.COMPONENT), (3, "TSS 2", standards.COMPONENT), (3, "TSS 3", standards.MATERIAL),
    }
    assert {tuple(r) for r in standards.unresolved(drawings, n).collect()} == {(2, "compressor_series")}
    assert [r.part for r in p.orderBy("ord").collect()] == ["Connecting Rod", "Piston"]
