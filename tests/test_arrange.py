import random

import pytest

from paperloom.operators import arrange, outlines

SCHEMA = "page long, id long, left double, top double, right double, bottom double"


def objects(seed, n, pages=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(0, 900) / 1000, r.randrange(0, 900) / 1000
        out.append((r.randrange(pages), i, x, y, x + r.randrange(0, 90) / 1000, y + r.randrange(0, 90) / 1000))
    return out


def snap(rows, i, low, high):
    """The nearest anchor of any other object by trying all, then the page's guides."""
    page, own = rows[i][0], (rows[i][low], (rows[i][low] + rows[i][high]) / 2, rows[i][high])
    best = []
    for j, o in enumerate(rows):
        if j != i and o[0] == page:
            best += [(round(abs(g - a), 9), g, a, g - a) for g in (o[low], (o[low] + o[high]) / 2, o[high]) for a in own]
    near = min((b for b in best if b[0] < 0.012), default=None)
    if near:
        return near[1], near[3]
    for line in (0.25, 0.5, 0.75):
        if round(abs(own[1] - line), 9) < 0.014:
            return line, line - own[1]
    if round(abs(own[0]), 9) < 0.014:
        return 0.0, -own[0]
    if round(abs(own[2] - 1), 9) < 0.014:
        return 1.0, 1 - own[2]
    return None, 0.0


def test_snap_equals_trying_all_pairs(spark):
    for seed, n in ((1, 40), (2, 150), (3, 1)):
        rows = objects(seed, n)
        got = {r["id"]: r for r in arrange.snapped(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert len(got) == n
        for i, r in enumerate(rows):
            (gx, dx), (gy, dy) = snap(rows, i, 2, 4), snap(rows, i, 3, 5)
            g = got[i]
            assert (g["guide_x"], g["guide_y"]) == pytest.approx((gx, gy))
            assert max(abs(g["left"] - r[2] - dx), abs(g["right"] - r[4] - dx), abs(g["top"] - r[3] - dy)) < 1e-9


def test_snap_compares_no_pairs(spark):
    plan = arrange.snapped(spark.createDataFrame(objects(1, 5), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and all("(page" in x and "(id" in x and "<" not in x.split("Join")[1] for x in joins)


def test_align_and_distribute(spark):
    rows = [(1, 1, 0.1, 0.1, 0.3, 0.2), (1, 2, 0.5, 0.4, 0.6, 0.8), (1, 3, 0.2, 0.0, 0.4, 0.1), (2, 4, 0.7, 0.7, 0.8, 0.8)]
    df = spark.createDataFrame(rows, SCHEMA)
    place = lambda d, c: {r["id"]: round(r[c], 6) for r in d.collect()}
    assert place(arrange.aligned(df, "left"), "left") == {1: 0.1, 2: 0.1, 3: 0.1, 4: 0.7}
    assert place(arrange.aligned(df, "right"), "right") == {1: 0.6, 2: 0.6, 3: 0.6, 4: 0.8}
    assert place(arrange.aligned(df, "hcenter"), "left") == {1: 0.25, 2: 0.3, 3: 0.25, 4: 0.7}
    assert place(arrange.aligned(df, "bottom"), "top") == {1: 0.7, 2: 0.4, 3: 0.7, 4: 0.7}
    assert place(arrange.distributed(df, "x"), "left") == {1: 0.1, 2: 0.5, 3: 0.275, 4: 0.7}
    assert place(arrange.page_aligned(df, "hcenter"), "left") == {1: 0.4, 2: 0.45, 3: 0.4, 4: 0.45}
    assert place(arrange.page_aligned(df, "bottom"), "bottom") == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}
    assert arrange.snapped(df.where("false")).count() == 0


def walk(nodes):
    """Depth first, from the roots."""
    children, out = {}, {}
    ids = {(d, i) for d, i, _, _ in nodes}
    for d, i, p, closed in sorted(nodes, key=lambda n: (n[0], n[1])):
        children.setdefault((d, p) if (d, p) in ids else d, []).append((d, i, closed))
    for d in {n[0] for n in nodes}:
        stack, place = [(x, 0, True) for x in reversed(children.get(d, []))], 0
        while stack:
            (_, i, closed), depth, visible = stack.pop()
            out[d, i] = (depth, visible, place if visible else None)
            place += visible
            stack += [(x, depth + 1, visible and not closed) for x in reversed(children.get((d, i), []))]
    return out


def test_outlines_of_any_depth(spark):
    r = random.Random(6)
    nodes = [(1, i, i - 1 if i else None, i == 700) for i in range(1000)]
    for d in range(2, 30):
        stack = []
        for i in range(r.randrange(1, 40)):
            stack = stack[: r.randrange(len(stack) + 1)]
            nodes.append((d, i, stack[-1] if stack else r.choice([None, 999]), r.random() < 0.3))
            stack.append(i)
    df = spark.createDataFrame(nodes, "doc long, idx long, parent long, closed boolean")
    got = {(x["doc"], x["idx"]): (x["depth"], x["visible"], x["place"]) for x in outlines.flattened(df).collect()}
    assert got == walk(nodes)
    assert got[1, 999][0] == 999 and got[1, 700][1] and not got[1, 701][1]


def test_toggle_and_circles(spark):
    df = spark.createDataFrame([(1, 0, None, False), (1, 1, 0, True)], "doc long, idx long, parent long, closed boolean")
    chosen = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (9, 9)], "doc long, idx long")
    assert sorted((x["idx"], x["closed"]) for x in outlines.toggled(df, chosen).collect()) == [(0, True), (1, True)]
    assert {x["closed"] for x in outlines.all_set(df, True).collect()} == {True}
    with pytest.raises(ValueError, match="circle"):
        outlines.flattened(spark.createDataFrame([(1, 0, 1, False), (1, 1, 0, False)], df.schema))


def test_few_anchors_are_dealt_to_two_cells(spark):
    anchors = spark.range(4000).selectExpr("1L AS page", "id", "id / 4000 AS at")
    dealt = arrange._dealt(anchors, 0.012)
    assert dealt.where("own").count() == 4000 and dealt.count() < 5200
