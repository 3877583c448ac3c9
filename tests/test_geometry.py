"""The ordered, greedy steps against plain statements of their rules, on random pages."""

import random

from sheetwise.operators import frames, tiles, zones

BOX = "page_id long, ord long, x0 double, y0 double, x1 double, y1 double, n_cells int"


def random_boxes(pages=60, n=12, seed=3):
    r, rows = random.Random(seed), []
    for p in range(pages):
        for k in range(n):
            x, y = r.randint(0, 30), r.randint(0, 30)
            rows.append((p, k, float(x), float(y), float(x + r.randint(1, 25)), float(y + r.randint(1, 25)), r.randint(2, 5)))
    return rows


def area(b):
    return (b[4] - b[2]) * (b[5] - b[3])


def greedy(rows, key, drops):
    kept = []
    for b in sorted(rows, key=key):
        if not any(drops(b, k) for k in kept):
            kept.append(b)
    return kept


def test_nested_and_overlapping_frames(spark):
    rows = random_boxes()

    def nested(b, k):
        return k[2] - 0.5 <= b[2] and k[3] - 0.5 <= b[3] and b[4] <= k[4] + 0.5 and b[5] <= k[5] + 0.5

    def overlapping(b, k):
        w, h = min(b[4], k[4]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[3], k[3])
        inter = w * h if w > 0 and h > 0 else 0
        return inter > 0 and (inter / (area(b) + area(k) - inter) >= 0.5 or inter / min(area(b), area(k)) >= 0.9)

    df = spark.createDataFrame(rows, BOX)
    for op, key, drops in (
        (frames.frame_nested, lambda b: (-area(b), b[1]), nested),
        (frames.frame_nms, lambda b: (-b[6], -area(b), b[1]), overlapping),
    ):
        want = {(p, *b[2:]) for p in range(60) for b in greedy([b for b in rows if b[0] == p], key, drops)}
        assert {(r.page_id, r.x0, r.y0, r.x1, r.y1, r.n_cells) for r in op(df).collect()} == want


def test_spacing_counts_from_the_last_kept(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0, 6.0, 7.0, 12.0])], "k int, xs array<double>")
    assert df.select(frames.spaced("xs").alias("s")).first().s == [0.0, 6.0, 12.0]


def test_merge_chains_and_bridges(spark):
    rows = [(1, "h", 10.0, 0.0, 5.0), (1, "h", 10.8, 6.0, 9.0), (1, "h", 11.6, 20.0, 30.0), (1, "h", 13.0, 0.0, 5.0), (1, "h", 10.0, 2.0, 3.0)]
    got = frames.merge_segments(spark.createDataFrame(rows, "page_id long, axis string, at double, lo double, hi double"), "h").collect()
    assert sorted((round(r["at"], 6), r.lo, r.hi) for r in got) == [(10.6, 0.0, 9.0), (10.6, 20.0, 30.0), (13.0, 0.0, 5.0)]


def progression(points):
    """The rule, by rescanning from the start after each step."""
    best, best_step = [], None
    for i in range(len(points)):
        for j in range(i + 1, len(points)):
            step = points[j][0] - points[i][0]
            if step <= 1.0:
                continue
            chain = [points[i], points[j]]
            while nxt := next((p for p in points if p[1] not in {c[1] for c in chain} and abs(p[0] - (chain[-1][0] + step)) <= step * 0.06), None):
                chain.append(nxt)
            if len(chain) > len(best):
                best, best_step = chain, step
    return best, best_step


def test_progressions(spark):
    r, rows, want = random.Random(5), [], {}
    for page in range(40):
        points = sorted({(float(round(r.choice([k * 50 + r.randint(-2, 2), r.randint(0, 400)]), 1)), str(r.randint(1, 9))) for k in range(8)})
        rows += [(page, "col", label, at, 1200.0, 800.0) for at, label in points]
        want[page] = progression(points)
    df = spark.createDataFrame(rows, "page_id long, axis string, label string, coord double, page_w double, page_h double")
    got = {x.page_id: ([tuple(p) for p in x.chain], x.step) for x in zones.progressions(df).collect()}
    for page, (chain, step) in want.items():
        if chain:
            assert got[page][0] == chain and abs(got[page][1] - step) < 1e-9
        else:
            assert page not in got


def test_diff_regions(spark):
    r = random.Random(9)
    cells = {(p, r.randint(0, 14), r.randint(0, 14)) for p in range(6) for _ in range(60)}
    want = []
    for p in range(6):
        todo = {(x, y) for q, x, y in cells if q == p}
        while todo:
            stack, size = [todo.pop()], 0
            while stack:
                x, y = stack.pop()
                size += 1
                near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
                todo -= near
                stack += near
            want.append((p, size))
    df = spark.createDataFrame([(p, 1, x, y) for p, x, y in cells], "pair_id long, page int, tx int, ty int")
    assert sorted((x.pair_id, x["size"]) for x in tiles.diff_regions(df, close=0, dilate=0).collect()) == sorted(want)
    alone = spark.createDataFrame([(1, 1, 5, 5)], df.schema)
    assert [(x["size"], x.x0, x.y1) for x in tiles.diff_regions(alone).collect()] == [(9, 4, 6)]
    assert tiles.diff_regions(alone, min_size=9).count() == tiles.diff_regions(alone.limit(0)).count() == 0


def test_tile_on_one_side_is_changed(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0, 10), (1, 1, 2, 0, 0, 25), (1, 1, 1, 1, 0, 10), (1, 1, 2, 1, 0, 26), (1, 1, 2, 2, 0, 1)], "pair_id long, page int, rev int, tx int, ty int, gray int")
    assert sorted((r.tx, r.ty) for r in tiles.page_tile_diff(df).collect()) == [(1, 0), (2, 0)]
