import zlib
from collections import Counter

import numpy as np

from paperloom.llm import sharding
from tests.llm.data import docs, no_docs, odd_rows, prose


def test_whole_balanced_and_gapless(spark):
    texts = [prose(i, 5 + i % 60) for i in range(1500)] + [prose(9999, 12)] * 900 + [prose(5000 + i, 30) for i in range(40)] * 3
    df = docs(spark).where("doc_id <> 7").unionByName(docs(spark, texts, first=100))
    got = sharding.shard(df, heavy=16, cell=300).collect()
    source = [(i, t) for i, t, *_ in odd_rows() if i is not None and i != 7] + [(100 + i, t) for i, t in enumerate(texts)]
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in source)
    sums, slots = Counter(), {}
    for r in got:
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert len(sums) == 16 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sums.values()) / 16
    assert max(sums.values()) < 1.03 * mean and min(sums.values()) > 0.97 * mean
    counts = [len(x) for x in slots.values()]
    assert max(counts) < 1.05 * len(got) / 16
    # Only the text that no shard could hold is split.
    text_of = dict(source)
    homes = {}
    for r in got:
        homes.setdefault(text_of[r["doc_id"]], set()).add(r["shard"])
    assert [t for t, s in homes.items() if len(s) > 1] == [prose(9999, 12)]


def test_place_takes_the_highest_dot_product():
    residual = np.array([[10.0, 1.0, 5.0], [1.0, 10.0, 5.0]])
    assert list(sharding.place(np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), residual, np.ones(3))) == [0, 1]
    assert residual.tolist() == [[9.0, 1.0, 5.0], [1.0, 9.0, 5.0]]


def test_a_heavy_text_of_one_id_is_cut_evenly(spark):
    """Equal rows with one doc_id, or none, fill the shards like any others."""
    for heavy_id in (5, None):
        rows = [(heavy_id, "the same text")] * 320 + [(100 + i, f"text {i:08d}") for i in range(320)]
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), cell=100).collect()
        sums, slots = Counter(), {}
        for r in got:
            sums[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert len(got) == 640 and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(sums.values()) - min(sums.values()) <= 3 * 14


def test_all_three_measures_are_about_as_even_as_by_one_list(spark):
    """Against placing all groups in one list: bytes, tokens and rows over shards."""
    r = np.random.default_rng(3)
    texts = [" ".join(["w" * int(n)] * int(k)) + f" {i}" for i, (n, k) in enumerate(zip(r.integers(1, 12, 1200), r.integers(1, 60, 1200)))]
    got = sharding.shard(docs(spark, texts), heavy=64, cell=200).collect()
    measures = np.zeros((16, 3))
    for x in got:
        measures[x["shard"]] += (x["size"], x["n_tokens"], 1)
    vectors = np.array([(len(t) + 1, len(t.split()), 1) for t in texts], float)
    capacity = vectors.sum(axis=0) / 16
    residual = np.tile(capacity, (16, 1))
    sharding.place(vectors, residual, capacity)
    one_list = np.abs(residual / capacity).max(axis=0)
    ours = np.abs(measures / capacity - 1).max(axis=0)
    assert (ours <= one_list + 0.05).all()


def test_one_document_and_none(spark):
    assert [r["slot"] for r in sharding.shard(docs(spark, ["x"])).collect()] == [0]
    assert sharding.shard(no_docs(spark)).count() == 0
