import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import images


def naive_energy(g):
    h, w = len(g), len(g[0])
    rows, cols = [0.0] * h, [0.0] * w
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gx = sum(k * (g[y + d][x + 1] - g[y + d][x - 1]) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (g[y + 1][x + d] - g[y - 1][x + d]) for d, k in ((-1, 1), (0, 2), (1, 1)))
            rows[y] += math.hypot(gx, gy)
            cols[x] += math.hypot(gx, gy)
    return rows, cols


def test_energy_and_bands_equal_loops():
    r = random.Random(1)
    for _ in range(20):
        g = np.array([[r.randrange(256) for _ in range(r.choice([13]))] for _ in range(9)])
        rows, cols = images.edge_energy(g)
        want = naive_energy(g.tolist())
        assert np.allclose(rows, want[0]) and np.allclose(cols, want[1])
        e = [r.choice([0, 1, 5, 10]) for _ in range(12)]
        runs = [(i, j) for i in range(12) for j in range(i, 12) if all(x >= 0.3 * max(e) for x in e[i : j + 1])]
        best = max(runs, key=lambda x: (x[1] - x[0], -x[0])) if max(e) else None
        assert images.longest_band(np.array(e, float), 0.3) == best


def page(r, w=80, h=64):
    left, top, right, bottom = r.randrange(3, 25), r.randrange(3, 18), r.randrange(50, 76), r.randrange(40, 60)
    g = [[(230 if (x + y) % 3 else 120) if left <= x < right and top <= y < bottom else 30 for x in range(w)] for y in range(h)]
    return (w, h, [v for row in g for v in row]), (left, top, right, bottom)


def test_planted_pages_are_found(spark):
    r = random.Random(2)
    drawn = [page(r) for _ in range(30)]
    odd = [(80, 64, None), (80, 64, [1, 2]), (0, 0, []), (4, 4, [7] * 16), (2, 1, [1, 9])]
    df = spark.createDataFrame([(i, *x, "c") for i, x in enumerate([d for d, _ in drawn] + odd)], "image int, width int, height int, gray array<int>, edges string")
    rows = {x["image"]: x for x in images.detected_pages(df).collect()}
    for i, (_, (left, top, right, bottom)) in enumerate(drawn):
        c = rows[i]["corners"]
        assert rows[i]["confidence"] == 0.6 and not rows[i]["fallback"]
        assert max(abs(c[0]["x"] - left), abs(c[0]["y"] - top), abs(c[2]["x"] - right), abs(c[2]["y"] - bottom)) <= 1
    assert all(rows[30 + i]["fallback"] and rows[30 + i]["confidence"] == 0 for i in range(5))


def ordered(points):
    """Corners by extremes, else around the centre, as the rule says."""
    pick = lambda key, way: way(points, key=key)
    c = [pick(lambda p: p[0] + p[1], min), pick(lambda p: p[1] - p[0], min), pick(lambda p: p[0] + p[1], max), pick(lambda p: p[1] - p[0], max)]
    turn = [(c[(i + 1) % 4][0] - c[i][0]) * (c[(i + 2) % 4][1] - c[(i + 1) % 4][1]) - (c[(i + 1) % 4][1] - c[i][1]) * (c[(i + 2) % 4][0] - c[(i + 1) % 4][0]) for i in range(4)]
    if len(points) > 4 or len(set(c)) == 4 and (min(turn) > -1e-9 or max(turn) < 1e-9):
        return c
    cx, cy = sum(p[0] for p in points) / 4, sum(p[1] for p in points) / 4
    ring = sorted(points, key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
    k = min(range(4), key=lambda i: sum(ring[i]))
    return ring[k:] + ring[:k]


def score(c, w, h):
    e = [math.dist(c[i], c[(i + 1) % 4]) for i in range(4)]
    turn = [(c[(i + 1) % 4][0] - c[i][0]) * (c[(i + 2) % 4][1] - c[(i + 1) % 4][1]) - (c[(i + 1) % 4][1] - c[i][1]) * (c[(i + 2) % 4][0] - c[(i + 1) % 4][0]) for i in range(4)]
    share = abs(sum(c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in range(4))) / 2 / (w * h)
    shape = max(e[0], e[2]) / max(e[1], e[3]) if max(e[1], e[3]) else 0
    if not (min(turn) > -1e-9 or max(turn) < 1e-9) or not 0.1 <= share <= 0.999 or not 0.15 <= shape <= 6.5 or min(e) < 0.05 * min(w, h):
        return 0.0
    angles = 0
    for i in range(4):
        a, b = [(c[i - 1][k] - c[i][k]) for k in (0, 1)], [(c[(i + 1) % 4][k] - c[i][k]) for k in (0, 1)]
        cosine = (a[0] * b[0] + a[1] * b[1]) / (math.hypot(*a) * math.hypot(*b))
        angles += max(0, 1 - abs(math.acos(max(-1, min(1, cosine))) - math.pi / 2) / (math.pi / 2))
    return 0.4 * (1 - min(1, abs(share - 0.65) / 0.65)) + 0.35 * (min(e[0], e[2]) / max(e[0], e[2]) + min(e[1], e[3]) / max(e[1], e[3])) / 2 + 0.25 * angles / 4


def test_best_quads_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i % 40, 100, 80, i, [(float(r.randrange(101)), float(r.randrange(81))) for _ in range(r.choice([4, 4, 4, 7, 3]))]) for i in range(400)]
    df = spark.createDataFrame(rows, f"image int, width int, height int, rank int, points {images.QUAD}")
    got = {x["image"]: x for x in images.best_quads(df).collect()}
    for image in range(40):
        scored = [(score(ordered(p), 100, 80), -k, ordered(p)) for i, _, _, k, p in rows if i == image and len(p) >= 4]
        s, _, quad = max(scored, default=(0, 0, None))
        assert got[image]["confidence"] == pytest.approx(s) and got[image]["fallback"] == (s == 0)
        if s:
            assert [tuple(p) for p in got[image]["corners"]] == quad


def test_maps_take_corners_to_corners_and_back():
    r = np.random.default_rng(4)
    quads = np.array([[0, 0], [50, 0], [50, 40], [0, 40]]) + r.uniform(-9, 9, (200, 4, 2))
    target = np.broadcast_to(np.array([[0.0, 0], [60, 0], [60, 30], [0, 30]]), (200, 4, 2))
    there, back = images.homographies(quads, target), images.homographies(target, quads)
    assert np.allclose(images.mapped(there, quads), target) and np.allclose(images.mapped(back, target), quads)
    inner = r.uniform(5, 35, (200, 7, 2))
    assert np.allclose(images.mapped(back, images.mapped(there, inner)), inner)
    flat = np.zeros((2, 4, 2))
    flat[1] = np.nan
    assert np.isnan(images.homographies(target[:2], flat)[1]).all()


def test_flattening_equals_a_loop_over_pixels(spark):
    r = random.Random(5)
    w, h = 23, 17
    gray = [r.randrange(256) for _ in range(w * h)]
    corners = [(3.0, 2.0), (20.0, 1.0), (21.5, 15.0), (1.0, 13.0)]
    df = spark.createDataFrame([(1, w, h, gray, corners), (2, w, h, gray, [(1.0, 1.0)] * 4), (3, w, h, None, corners), (4, w, h, gray, None)], f"image int, width int, height int, gray array<int>, corners {images.QUAD}")
    got = {x["image"]: x["flat"] for x in images.flattened(df).collect()}
    assert got[3] is None and got[4] is None and (got[2] is None or len(got[2]["gray"]) == 1)
    ow = int(max(math.dist(corners[0], corners[1]), math.dist(corners[2], corners[3])) + 0.5)
    oh = int(max(math.dist(corners[1], corners[2]), math.dist(corners[3], corners[0])) + 0.5)
    m = images.homographies(np.array([[[0, 0], [ow, 0], [ow, oh], [0, oh]]], float), np.array([corners]))[0]
    want = []
    for y in range(oh):
        for x in range(ow):
            a, b, c = m @ [x, y, 1]
            sx, sy = min(max(a / c, 0), w - 1), min(max(b / c, 0), h - 1)
            i, j = int(sy), int(sx)
            i1, j1 = min(i + 1, h - 1), min(j + 1, w - 1)
            at = lambda q, p: gray[q * w + p]
            top = at(i, j) + (at(i, j1) - at(i, j)) * (sx - j)
            low = at(i1, j) + (at(i1, j1) - at(i1, j)) * (sx - j)
            want.append(int(top + (low - top) * (sy - i) + 0.5))
    assert (got[1]["width"], got[1]["height"]) == (ow, oh) and got[1]["gray"] == want
    small = images.flattened(df.where("image = 1"), 10).first()["flat"]
    assert max(small["width"], small["height"]) == 10


def test_flattening_brings_a_planted_page_upright(spark):
    """A page drawn through a map comes out as it was, but for rounding."""
    page_ = np.add.outer(np.arange(30) * 3, np.arange(40) * 4) + 20
    quad = np.array([[[12.0, 8], [75, 14], [70, 60], [9, 55]]])
    to_page = images.homographies(quad, np.array([[[0.0, 0], [40, 0], [40, 30], [0, 30]]]))
    x, y = np.meshgrid(np.arange(90), np.arange(70))
    at = images.mapped(to_page, np.stack([x.ravel(), y.ravel()], 1)[None].astype(float))[0]
    photo = images.sampled(page_, at[:, 0], at[:, 1])
    df = spark.createDataFrame([(90, 70, photo.tolist(), [tuple(map(float, p)) for p in quad[0]])], f"width int, height int, gray array<int>, corners {images.QUAD}")
    flat = images.flattened(df).first()["flat"]
    back = np.array(flat["gray"]).reshape(flat["height"], flat["width"])
    rows, cols = np.arange(back.shape[0]) * 30 / back.shape[0], np.arange(back.shape[1]) * 40 / back.shape[1]
    inside = (slice(2, -4), slice(2, -4))
    assert np.abs(back - (np.add.outer(rows * 3, cols * 4) + 20))[inside].max() <= 3


def test_fill_check(spark):
    white, near, far = (255, 255, 255), (231, 240, 250), (230, 255, 255)
    cases = [[], [white] * 97 + [far] * 3, [white] * 96 + [far] * 4, [near] * 10]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, pixels array<struct<r:int,g:int,b:int>>")
    fill = {c: F.lit(255) for c in "rgb"}
    assert [r["f"] for r in df.select("i", images.shows_fill(F.col("pixels"), fill).alias("f")).orderBy("i").collect()] == [True, True, False, True]


def test_large_images_are_searched_as_thumbnails():
    g = np.arange(1000 * 400).reshape(400, 1000)
    assert images.thumbnail(g).shape == (128, 320) and images.thumbnail(g[:5, :5]).shape == (5, 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quads_are_scored_by_batches_and_not_by_expressions_within_expressions(spark):
    made = plan(images.best_quads(spark.createDataFrame([], f"image int, width int, height int, rank int, points {images.QUAD}")))
    assert made.count("lambdafunction") == 0 and made.count("ArrowEvalPython") == 1


def test_a_null_or_missing_point_leaves_no_quad(spark):
    square = [(10.0, 10.0), (90.0, 10.0), (90.0, 70.0), (10.0, 70.0)]
    rows = [(0, 100, 80, 0, square), (1, 100, 80, 0, square[:3]), (2, 100, 80, 0, None), (3, 100, 80, 0, [*square, None]), (4, 100, 80, 0, [(None, 1.0), *square]), (5, 0, 0, 0, square), (6, None, 80, 0, square)]
    got = images.best_quads(spark.createDataFrame(rows, f"image int, width int, height int, rank int, points {images.QUAD}")).collect()
    assert {x["image"]: x["fallback"] for x in got} == {0: False, **{i: True for i in range(1, 7)}}


def test_energy_and_bands_of_many_images_are_those_of_each(monkeypatch, spark):
    r = np.random.default_rng(6)
    many = r.integers(0, 256, (5, 9, 13))
    for axis, of_all in enumerate(images.edge_energy(many)):
        assert np.allclose(of_all, [images.edge_energy(g)[axis] for g in many])
        assert images.longest_bands(of_all, 0.6).tolist() == [list(images.longest_band(e, 0.6)) for e in of_all]
    assert (images.thumbnail(many, 4) == [images.thumbnail(g, 4) for g in many]).all()
    monkeypatch.setattr(images, "BLOCK", 150)
    rr = random.Random(7)
    drawn = [page(rr, *rr.choice([(80, 64), (90, 64), (78, 61)]))[0] for _ in range(12)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(drawn)], "image int, width int, height int, gray array<int>")
    for x in images.energy_bands(df.coalesce(1)).collect():
        w, h, gray = drawn[x["image"]]
        (top, bottom), (left, right) = (images.longest_band(np.array(e)) for e in naive_energy(np.array(gray).reshape(h, w).tolist()))
        assert x["bands"] == pytest.approx([top / h, (bottom + 1) / h, left / w, (right + 1) / w])


def test_flattened_pixels_are_summed_in_the_task_that_makes_them(spark):
    made = plan(images.flattened_pages(spark, "/root/testdata/sf0.001"))
    assert made.count("ArrowEvalPython") == 1 and "lambdafunction" not in made


def test_flattening_many_images_is_flattening_each(spark):
    r = random.Random(8)
    rows = []
    for i in range(30):
        w, h = r.choice([(23, 17), (20, 31)])
        lean = r.choice([0.0, 1.5, 3.0])
        rows.append((i, w, h, [r.randrange(256) for _ in range(w * h)], [(1.0 + lean, 2.0), (w - 3.0, 1.0), (w - 2.0 - lean, h - 2.0), (1.0, h - 3.0)]))
    df = spark.createDataFrame(rows, f"image int, width int, height int, gray array<int>, corners {images.QUAD}")
    together = {x["image"]: x["flat"] for x in images.flattened(df.coalesce(1)).collect()}
    apart = {x["image"]: x["flat"] for x in images.flattened(df.repartition(30, "image")).collect()}
    assert together == apart and len({(f["width"], f["height"]) for f in together.values()}) > 2
