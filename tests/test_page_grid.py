"""What lies near on a page meets by squares, groups and runs: results against plain loops, and work that doesn't grow with the page."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import cells, frames, tiles, zones

FRAME = "page_id long, ord long, x0 double, y0 double, x1 double, y1 double, n_cells int"


def sheet(n):
    """n x n cells of 20 by 10 points, 30 apart, and a word in each."""
    at = [(k, 30.0 * (k % n), 30.0 * (k // n)) for k in range(n * n)]
    return [(1, k, x, y, x + 20, y + 10) for k, x, y in at], [(1, k, x + 4, y + 2, x + 8, y + 6, f"w{k}") for k, x, y in at]


def test_words_compared_with_a_cell_do_not_grow_with_the_page(spark):
    shares = []
    for n in (10, 40):
        boxes, words = sheet(n)
        c = spark.createDataFrame(boxes, "page_id long, cell long, x0 double, y0 double, x1 double, y1 double")
        w = spark.createDataFrame(words, "page_id long, ord long, x0 double, y0 double, x1 double, y1 double, text string")
        shares.append(frames.word_candidates(c, w).count() / n**2)
        got = {r.cell: r.texts for r in frames.words_in_cell(c, w, "cell").collect()}
        assert got == {k: [f"w{k}"] for k in range(n * n)}
    assert max(shares) < 6 and shares[1] < 1.3 * shares[0]


def test_lines_compared_with_a_pair_do_not_grow_with_the_page(spark):
    shares = []
    for n in (10, 40):
        pairs = spark.createDataFrame([(1, k, k, 50.0 * (k // n) + 10, 50.0 * (k // n) + 30, 100.0 * (k % n), 100.0 * (k % n) + 60) for k in range(n * n)], "page_id long, top_id long, bottom_id long, top double, bottom double, left double, right double")
        lines = spark.createDataFrame([(1, 100.0 * (k % n) + dx, 50.0 * (k // n) + 8, 50.0 * (k // n) + 33) for k in range(n * n) for dx in (0, 30, 61, 80)], "page_id long, at double, lo double, hi double")
        shares.append(frames.line_candidates(pairs, lines).count() / n**2)
        assert frames.line_crossings(pairs, lines).count() == 3 * n * n
    assert max(shares) < 10 and shares[1] < 1.3 * shares[0]


def test_words_and_matches_at_edges_against_loops(spark):
    rnd = random.Random(3)
    boxes = [(p, k, x, y, x + rnd.choice([0, 5, 40, 90, 400]), y + rnd.choice([0, 10, 40])) for p in (1, 2) for k in range(60) for x, y in [(float(rnd.choice([0, 40, 80, rnd.randint(-30, 300)])), float(rnd.choice([0, 40, rnd.randint(-30, 200)])))]]
    points = [(p, k, float(rnd.choice([0, 40, 80, 120, rnd.randint(-30, 500)])), float(rnd.choice([0, 40, rnd.randint(-30, 240)]))) for p in (1, 2, 3) for k in range(80)]
    c = spark.createDataFrame([tuple(map(float, b[2:])) + b[:2] for b in boxes], "x0 double, y0 double, x1 double, y1 double, page_id long, cell long")
    w = spark.createDataFrame([(p, k, x, y, x, y, f"w{k}") for p, k, x, y in points], "page_id long, ord long, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.page_id, r.cell): r.texts for r in frames.words_in_cell(c, w, "cell").collect()}
    want = {(p, k): [f"w{i}" for q, i, x, y in points if q == p and x0 <= x <= x1 and y0 <= y <= y1] for p, k, x0, y0, x1, y1 in boxes}
    assert got == {k: v for k, v in want.items() if v}
    m = w.select("page_id", F.col("text").alias("symbol"), F.lit(0.5).alias("score"), F.lit(1.0).alias("scale"), "x0", "y0", "x1", "y1")
    free = sorted((r.page_id, r.symbol) for r in cells.uncovered_matches(m, c).collect())
    assert free == sorted((p, f"w{i}") for p, i, x, y in points if not any(q == p and x0 - 3 <= x <= x1 + 3 and y0 - 3 <= y <= y1 + 3 for q, _, x0, y0, x1, y1 in boxes))


def test_survivors_are_both_steps(spark):
    rnd, rows = random.Random(6), []
    for page in range(30):
        for k in range(40):
            x, y = rnd.randint(0, 300), rnd.randint(0, 200)
            rows.append((page, k, float(x), float(y), float(x + rnd.choice([20, 40, 60])), float(y + rnd.choice([8, 10, 30])), rnd.randint(2, 6)))
    df = spark.createDataFrame(rows, FRAME)
    show = lambda t: sorted(map(tuple, t.collect()))
    assert show(frames.frame_survivors(df)) == show(frames.frame_nms(frames.frame_nested(df)))


def test_a_page_of_20000_frames(spark):
    rows = [(1, 4 * k + j, 90.0 * (k % 100) + d, 40.0 * (k // 100) + d, 90.0 * (k % 100) + 60 - d, 40.0 * (k // 100) + 20 - d / 2, 3) for k in range(5000) for j, d in enumerate((0.0, 1.0, 2.0, 3.0))]
    begin = time.perf_counter()
    assert frames.frame_survivors(spark.createDataFrame(rows, FRAME)).count() == 5000
    assert time.perf_counter() - begin < 60


def test_the_two_best_are_kept_before_the_shuffle(spark):
    rows = [(c, r, f"t{k:04d}", (k * 37 % 1000) / 1000) for c in range(3) for r in ("gray", "edges") for k in range(1000)]
    ranked = cells.cell_ranking(spark.createDataFrame(rows, "cell_id long, representation string, template string, score double"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "collect_list" not in plan
    assert [(r.best_score, r.second_score) for r in ranked.collect()] == [(0.999, 0.998)] * 3


def test_chains_of_an_axis_with_many_labels():
    coords = [round(k * 7.3, 1) for k in range(1500)]
    begin = time.perf_counter()
    assert zones.longest_chain(coords, [str(k) for k in range(1500)]) == list(range(1500))
    assert time.perf_counter() - begin < 30
    assert zones.longest_chain([], []) == zones.longest_chain([1.0], ["1"]) == zones.longest_chain([1.0, 2.0], ["1", "2"]) == []


def flood(points):
    rest, out = set(points), []
    while rest:
        todo = [rest.pop()]
        region = set(todo)
        while todo:
            x, y = todo.pop()
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & rest
            rest -= near
            region |= near
            todo += near
        out.append((min((y << 32) + x for x, y in region), len(region), *(f(p[k] for p in region) for f in (min, max) for k in (0, 1))))
    return sorted(out)


SNAKE = [(x, y) for y in range(0, 41, 2) for x in range(30)] + [(0 if y % 4 == 1 else 29, y) for y in range(1, 41, 2)]


@pytest.mark.parametrize("band", [1, 2, 3, 1024])
def test_regions_do_not_depend_on_bands(spark, monkeypatch, band):
    monkeypatch.setattr(tiles, "BAND", band)
    rnd = random.Random(band)
    pages = {1: SNAKE, 2: [(rnd.randint(-9, 20), rnd.randint(-9, 20)) for _ in range(260)], 3: [(0, 0)]}
    df = spark.createDataFrame([(p, 1, x, y) for p, own in pages.items() for x, y in own], "pair_id long, page int, tx int, ty int")
    got = {}
    for r in tiles.diff_regions(df, close=0, dilate=0).collect():
        got.setdefault(r.pair_id, []).append((r.region, r["size"], r.x0, r.y0, r.x1, r.y1))
    assert {p: sorted(rows) for p, rows in got.items()} == {p: flood(own) for p, own in pages.items()}


def test_a_long_region_takes_no_rounds(spark):
    jobs = []
    for length in (20, 4000):
        df = spark.createDataFrame([(1, 1, 0, y) for y in range(length)], "pair_id long, page int, tx int, ty int")
        spark.sparkContext.setJobGroup(f"long-{length}", "")
        assert [r["size"] for r in tiles.diff_regions(df, close=0, dilate=0).collect()] == [length]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"long-{length}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[1] <= jobs[0] + 6


@pytest.mark.parametrize("band", [1, 4, 1024])
def test_growing_in_bands_against_loops(spark, monkeypatch, band):
    monkeypatch.setattr(tiles, "BAND", band)
    rnd = random.Random(band)
    pages = {p: {(rnd.randint(-9, 15), rnd.randint(-9, 15)) for _ in range(n)} for p, n in ((1, 60), (2, 200), (3, 1), (4, 20))}
    df = spark.createDataFrame([(p, 1, x, y) for p, own in pages.items() for x, y in own], "pair_id long, page int, tx int, ty int")
    around = lambda own: {(x + a, y + b) for x, y in own for a in (-1, 0, 1) for b in (-1, 0, 1)}
    closed = {p: {(x, y) for x, y in around(own) if around({(x, y)}) <= around(own)} for p, own in pages.items()}
    t = tiles.diff_regions(df, close=1, dilate=1)
    got = {}
    for r in t.collect():
        got.setdefault(r.pair_id, []).append((r.region, r["size"], r.x0, r.y0, r.x1, r.y1))
    assert {p: sorted(rows) for p, rows in got.items()} == {p: flood(around(own)) for p, own in closed.items()}


def test_growing_shuffles_changed_tiles_once(spark):
    df = spark.createDataFrame([(1, 1, 0, 0)], "pair_id long, page int, tx int, ty int")
    assert tiles._labelled(df, 1, 1)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_matches_and_cells_are_not_sent_to_every_task(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    m = c.selectExpr("page_id", "'s' as symbol", "0.5D as score", "1D as scale", "x0", "y0", "x1", "y1")
    assert "Broadcast" not in cells.uncovered_matches(m, c)._jdf.queryExecution().executedPlan().toString()


def test_no_task_sorts_or_gathers_before_its_rows_are_dealt(spark):
    from sheetwise.plans import catalog

    for name in ("frame_signature_dedup", "compare_standards", "extract_cited_standards"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        behind = plan.rstrip()[plan.rindex("Exchange"):] if name == "frame_signature_dedup" else plan.split("Exchange hashpartitioning")[-1]
        assert "repartition" in plan.lower() and not any(x in behind for x in ("Sort [", "Aggregate", "WindowGroupLimit")), name


def test_cells_are_ranked_on_their_row(spark):
    from sheetwise.plans import catalog

    for name in ("gdt_cells", "gdt_first_cell"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        behind = plan[: plan.index("Exchange")]  # the last step that deals rows: squares have been met, a page's cells follow
        assert "hashpartitioning(page_id" in plan[len(behind) :].splitlines()[0] and "Join" not in behind and "Scan" not in behind, name
        assert "hashpartitioning(cell" not in plan and plan.count("WindowGroupLimit") == 1, name


def test_ranking_on_the_row_and_of_rows(spark):
    rnd, rows = random.Random(4), []
    for c in range(200):
        for r in cells.REPRESENTATIONS:
            rows += [(c, r, f"t{k}", rnd.choice([0.5, 0.55, 0.67, 0.9, None, float("nan"), -0.1, 0.0])) for k in rnd.sample(range(6), rnd.choice([0, 1, 2, 5]))]
    scores = spark.createDataFrame(rows, "cell_id long, representation string, template string, score double")
    entry = cells.entry(F.col("template"), F.col("score"))
    lists = scores.groupBy("cell_id").agg(*(F.collect_list(F.when(F.col("representation") == r, entry)).alias(f"scores_{r}") for r in cells.REPRESENTATIONS))
    show = lambda t: {r.cell_id: str(r) for r in t.collect()}
    want = show(cells.cell_ranking(scores, table=True))
    assert len(want) > 150 and show(cells.ranked_on_row(lists, table=True)) == want
    empty = spark.createDataFrame([(1,)], "cell_id long").select("cell_id", *(F.lit(None).cast(lists.schema[f"scores_{r}"].dataType).alias(f"scores_{r}") for r in cells.REPRESENTATIONS))
    assert [(r.best, r.second, r.margin, r.agreement, r.accepted) for r in cells.ranked_on_row(empty).collect()] == [(None, None, 0.0, False, False)]


def test_pairs_of_lines_against_loops(spark):
    rnd, rows = random.Random(8), []
    for page in range(6):
        for _ in range(60):
            at, lo = rnd.choice([30.0, 35.0, 70.0, 75.1, 34.9, 115.0, rnd.randint(30, 300) + 0.1]), float(rnd.randint(0, 60))
            rows.append((page, at, lo, lo + rnd.choice([10.0, 15.0, 80.0])))
    h = spark.createDataFrame(rows, "page_id long, at double, lo double, hi double")
    got = sorted(tuple(r) for r in frames.line_pairs(h).select("page_id", "top_id", "bottom_id", "top", "bottom", "left", "right").collect())
    want = []
    for page in range(6):
        lines = sorted(r[1:] for r in rows if r[0] == page)
        for i, (top, a0, a1) in enumerate(lines):
            for j, (bottom, b0, b1) in enumerate(lines[i + 1 :], i + 1):
                if 5 <= bottom - top <= 40 and min(a1, b1) - max(a0, b0) >= 15:
                    want.append((page, i + 1, j + 1, top, bottom, max(a0, b0), min(a1, b1)))
    assert got == sorted(want) and len(want) > 500
    plan = frames.line_pairs(h)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
