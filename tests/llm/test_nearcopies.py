import random

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import common, nearcopies, simhash
from tests.llm.data import docs, prose


def jaccard(a, b):
    x, y = set(nearcopies.shingles(a).tolist()), set(nearcopies.shingles(b).tolist())
    return len(x & y) / len(x | y)


def edited(text, places):
    w = text.split()
    for i in places:
        w[i] = f"edit{i}"
    return " ".join(w)


def test_stage_removes_what_is_four_fifths_alike(spark):
    own = [prose(i, 120) for i in range(25)]
    near = [edited(t, [10, 70]) for t in own]  # 10 of 116 shingles change
    less = [edited(t, range(5, 115, 12)) for t in own]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(own, near)) and all(jaccard(a, b) < 0.8 for a, b in zip(own, less))
    bits = [(simhash.text_fingerprint(a) ^ simhash.text_fingerprint(b)).bit_count() for a, b in zip(own, near)]
    assert sum(x > 4 for x in bits) > 5  # which the fingerprints alone do not link
    apart = [i for i, (a, b) in enumerate(zip(own, less)) if (simhash.text_fingerprint(a) ^ simhash.text_fingerprint(b)).bit_count() > 4]
    group = prose(900, 100)
    many = [edited(group, [5 + i % 90]) for i in range(60)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, own + near + less + [group] + many), "").collect()}
    assert kept & set(range(50)) == set(range(25))
    assert {50 + i for i in apart} <= kept
    assert kept & set(range(75, 136)) == {75}


def pieces(nodes, pairs):
    """The sets of nodes that the pairs connect."""
    of = {x: {x} for x in nodes}
    for a, b in pairs:
        both = of[a] | of[b]
        for x in both:
            of[x] = both
    return {frozenset(x) for x in of.values()}


def random_sets(r, n):
    base = r.sample(range(1000), 40)
    return [np.array(sorted({*r.sample(base, r.randint(33, 40)), *r.sample(range(1000, 1100), r.randint(0, 6))}), np.int64) for _ in range(n)]


def alike(x, y):
    n = len(set(x.tolist()) & set(y.tolist()))
    return n >= 0.8 * (len(x) + len(y) - n)


def test_forest_equals_all_pairs():
    r = random.Random(3)
    for n in (1, 2, 30, 90):
        sets = random_sets(r, n)
        found = nearcopies.alike_forest(sets, 0.8)
        assert len(found) < n and all(alike(sets[a], sets[b]) for a, b in found)
        assert pieces(range(n), found) == pieces(range(n), [(a, b) for a in range(n) for b in range(a) if alike(sets[a], sets[b])])


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_groups_in_blocks(spark, block):
    r = random.Random(4)
    sets = random_sets(r, 60)
    group = [i % 3 if i > 10 else 0 for i in range(60)]
    rows = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(sets)], "node long, set array<long>")
    groups = spark.createDataFrame(list(enumerate(group)), "node long, component long")
    found = [(x["a"], x["b"]) for x in nearcopies.links_in_groups(rows, groups, 0.8, block).collect()]
    assert pieces(range(60), found) == pieces(range(60), [(a, b) for a in range(60) for b in range(a) if group[a] == group[b] and alike(sets[a], sets[b])])


def test_a_large_group_of_unlike_copies_makes_no_pairs(spark, monkeypatch):
    counts = {}

    def counted(df, name, *more):
        found = persisted(df, name, *more)
        counts[name] = max(counts.get(name, 0), found.count())
        return found

    persisted = common.persisted
    monkeypatch.setattr(common, "persisted", counted)
    monkeypatch.setattr(nearcopies, "persisted", counted)
    base, r = prose(901, 100), random.Random(6)
    texts = list(dict.fromkeys(edited(base, r.sample(range(5, 95), 2)) for _ in range(150)))[:120]
    found = [(x["a"], x["b"]) for x in nearcopies.links(docs(spark, texts)).select("a", "b").collect()]
    node = {x["h"]: x["doc_id"] for x in docs(spark, texts).selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    sets = [nearcopies.shingles(x) for x in texts]
    assert pieces(range(120), [(node[a], node[b]) for a, b in found]) == pieces(range(120), [(a, b) for a in range(120) for b in range(a) if alike(sets[a], sets[b])])
    assert max(counts.values()) <= nearcopies.BANDS * 120, counts
