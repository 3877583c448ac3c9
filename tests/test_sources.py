from pyspark.sql import functions as F

from sheetwise.operators import batch, standards
from sheetwise.sources import files


def test_sheets_and_logs(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('Standard,Content,Category,Applicability\ntss-1,"a, b",Material,All\n,x,y,z\n')
    notes = standards.clean_notes(files.read_notes(spark, str(tmp_path / "notes.csv")))
    assert [(r.standard, r.content, r.compressor_series, r.applicability) for r in notes.collect()] == [("TSS 1", "a, b", [], ["All"])]
    (tmp_path / "parts.csv").write_text("Part,Mandatory_Standards\nRod,iso 1; TSS_2\nRod,DIN3\n")
    parts = standards.clean_parts(files.read_parts(spark, str(tmp_path / "parts.csv")))
    assert [(r.part, r.mandatory) for r in parts.collect()] == [("Rod", ["DIN 3"])]
    (tmp_path / "log.csv").write_text(",".join(files.COST_LOG) + "\n2026-01-01,m,10,5,5,100.00,0.000002\n2026-01-01,m,x,5,5,1,1\n")
    assert tuple(batch.cost_summary(files.read_cost_log(spark, str(tmp_path / "log.csv"))).first()) == (1, 10, "$0.0000", "100.00")


def test_listing_and_writers(spark, tmp_path):
    for name in ("2/b.pdf", "2/a.pdf", "10/c.pdf", "x/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = batch.drawing_listing(files.list_drawings(spark, str(tmp_path))).orderBy("folder_no", "pos").collect()
    assert [(r.folder, r.name) for r in got] == [("2", "a.pdf"), ("2", "b.pdf"), ("10", "c.pdf")]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_records(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'
    files.write_sheet(df.withColumn("c", F.lit("x")), str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).columns == ["a", "b", "c"]
    calls = spark.createDataFrame([("2026-07-01T10:00:00", "m", 10, 5, 5, 12.345)], "timestamp string, modelo string, total_tokens long, prompt_tokens long, completion_tokens long, latencia_ms double")
    for _ in range(2):
        batch.append_costs(calls, str(tmp_path / "costs"))
    back = files.read_cost_log(spark, str(tmp_path / "costs")).drop("call_id").collect()
    assert [tuple(r) for r in back] == [("2026-07-01T10:00:00", "m", "10", "5", "5", f"{12.345:.2f}", "0.000002")] * 2
