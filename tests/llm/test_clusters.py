import hashlib
import math
import random

import numpy as np

from paperloom.llm import clusters


def brute(rows, k=8, rounds=10):
    """(id, cluster, distance) of each kept vector, and the centroids, one vector and one component at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(centres)):
            own = [v for (_, v), x in zip(kept, of) if x == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign())], centres


def test_equals_brute_force_with_odd_rows(spark):
    r = random.Random(1)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(r.gauss(i % 5, 1) * (i % 3 + 0.2)) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, [f32(r.gauss(0, 40000 if i else 1e30))] * 64) for i in range(3)]
    rows += [rows[0], rows[0], (400, [0.0] * 64), (401, [0.0] * 64)]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] * 64), (505, [float("nan")] + [0.0] * 63), (506, [float("inf")] * 64)]
    df = spark.createDataFrame([(*x, 7) for x in rows + odd], "vec_id long, embedding array<float>, cluster int")
    assigned, centres = clusters.cluster(df)
    want, want_centres = brute(rows)
    assert centres == want_centres
    got = sorted((x["id"], x["cluster"], x["distance"]) for x in assigned.collect())
    assert got == sorted((i, j, d if d < 2**63 else None) for i, j, d in want)
    out = clusters.digest(assigned, centres).collect()
    assert {x["centroid_sha256"] for x in out} == {hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest() for _, j, _ in want}
    small = [x for x in out if x["cluster_inertia"] is not None]
    assert small and all(x["cluster_inertia"] == sum(d for _, j, d in want if j == x["cluster"]) for x in small)


def test_bounds_never_exceed_distances_and_do_screen():
    r = np.random.default_rng(2)
    centres = (r.normal(0, 300, (8, 64)) + r.normal(0, 3000, (8, 8)).repeat(8, 1)).astype(np.int64)
    v = centres[r.integers(0, 8, 500)] + r.normal(0, 200, (500, 64)).astype(np.int64)
    cluster, best, n_exact = clusters.nearest(v, clusters.compressed(v), centres.tolist())
    all_d = ((v[:, None, :] - centres) ** 2).sum(2)
    assert (best == all_d.min(1)).all() and (cluster == all_d.argmin(1)).all() and n_exact.mean() < 2
    short, c = clusters.compressed(v), clusters.compressed(centres)
    bound = (short**2).sum(1)[:, None] + (c**2).sum(1) - 2 * short @ c.T
    assert (bound <= all_d * (1 + 1e-9) + 1).all()


def test_ties_go_to_the_smaller_number():
    centres = [[2] * 64, [-2] * 64, [2] * 64]
    v = np.array([[0] * 64, [2] * 64, [-2] * 64])
    assert clusters.nearest(v, clusters.compressed(v), centres)[0].tolist() == [0, 0, 1]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, distance string"
    none, centres = clusters.cluster(spark.createDataFrame([], schema))
    assert centres == [] and clusters.digest(none, centres).count() == 0
    few = spark.createDataFrame([(None, [1.0] * 64, "x"), (2, [-1.0] * 64, "x"), (2, [-1.0] * 64, "x")], schema)
    assigned, centres = clusters.cluster(few)
    assert len(centres) == 3 and centres[2] == [1024] * 64
    assert sorted((x["vec_id"] or 0, x["cluster"], x["inertia"]) for x in clusters.digest(assigned, centres).collect()) == [(0, 2, 0), (2, 0, 0), (2, 0, 0)]
