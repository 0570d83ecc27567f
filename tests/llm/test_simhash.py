import random

import numpy as np
import xxhash

from paperloom.llm import simhash
from tests.llm.data import docs, no_docs, odd_rows, prose


def fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(ids, fps, bits=4):
    label = list(range(len(ids)))
    for _ in ids:
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= bits and label[j] < label[i]:
                    label[i] = label[j]
    low = {}
    for i, g in zip(ids, label):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    return [low[g] for g in label]


def test_golay_keys_lose_no_link_up_to_four_bits():
    r = random.Random(5)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        keys = [set(simhash.bucket_keys(np.array([x], np.uint64))[0]) for x in (a, b)]
        assert keys[0] & keys[1]


def test_golay_code_is_perfect():
    values = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    home, near, real = simhash.golay_keys(values)
    assert set(real.sum(axis=1)) <= {1, 6}
    assert (near[:, 0] == home).all()


def test_rows_equal_brute_force(spark):
    near = prose(7, 400)
    texts = [prose(i, 60) for i in range(25)] + [near] * 3 + [near.replace("a", "e", k) for k in range(1, 12)]
    df = docs(spark).unionByName(docs(spark, texts, first=100))
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    source = [(i, t) for i, t, *_ in odd_rows()] + [(100 + i, t) for i, t in enumerate(texts)]
    fps = [fingerprint(t) for _, t in source]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(source, fps, component_of([i for i, _ in source], fps))]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)


def test_large_buckets_are_cut_and_lose_nothing(spark):
    base, r = 0x123456789ABCDEF0, random.Random(1)
    fps = {base}
    while len(fps) < 120:
        fps.add(r.choice(sorted(fps)) ^ 1 << r.randrange(64))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, block=7)
    found = simhash.components(links, "a", "b").collect()
    assert len({x["component"] for x in found}) == 1 and len(found) == len(fps)


def test_bucket_forest_is_linear():
    fps = np.array([1 << i for i in range(40)], np.uint64)
    assert len(simhash.bucket_forest(fps, 2)) == 39


def test_keep_first_and_empty_table(spark):
    df = docs(spark)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    texts = [r["text"] for r in kept.collect()]
    assert len([t for t in texts if not (t or "").split()]) == 1  # all without words are one group
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 7]
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.keep_first(no_docs(spark)).count() == 0


def test_components_stop_as_soon_as_all_links_are_stars(spark, monkeypatch):
    from paperloom.llm import common

    written, persisted = [], common.persisted
    monkeypatch.setattr(common, "persisted", lambda df, name, *a: written.append(name) or persisted(df, name, *a))
    links = spark.createDataFrame([(2, 1), (2, 3), (3, 2), (5, 5), (9, 8)], "a long, b long")
    found = sorted(tuple(r) for r in common.components(links, "a", "b").collect())
    assert found == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert len(written) == 2  # the links and one round


def test_links_of_both_kinds_are_followed_at_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    called, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda *a: called.append(a[-1]) or components(*a))
    a, b = prose(7, 400), prose(8, 400)
    texts = [a, f"{a} ", prose(9, 400), b, f"{b} "]  # 0 and 1, 3 and 4 have equal fingerprints
    df = docs(spark, texts)
    hashed = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    links = spark.createDataFrame([(hashed[1], hashed[3])], "a long, b long")
    assert sorted(r["doc_id"] for r in simhash.keep_first(df, text_links=links).collect()) == [0, 2]
    assert len(called) == 1
