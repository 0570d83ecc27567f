import random
from collections import defaultdict

from paperloom.llm import suffixes
from tests.llm.data import docs, no_docs, odd_rows, prose


def brute(source, length):
    words = [(i, (t or "").encode().split()) for i, t in source]
    places = defaultdict(set)
    for k, (_, w) in enumerate(words):
        for a in range(len(w) - length + 1):
            places[tuple(w[a : a + length])].add(k)
    out = []
    for i, w in words:
        spans = []
        for a in range(len(w) - length + 1):
            if len(places[tuple(w[a : a + length])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + length
                else:
                    spans.append([a, a + length])
        out += [(i, a, b) for a, b in spans]
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark):
    r = random.Random(3)
    shared = [prose(500 + i, n) for i, n in enumerate((49, 50, 51, 60, 90, 200))]
    texts = [prose(i, 120) for i in range(10)]
    texts += [f"{prose(20 + i, r.randint(0, 70))} {r.choice(shared)}\n{prose(60 + i, r.randint(0, 70))}" for i in range(30)]
    texts += [texts[0], "same word " * 80, "same word " * 70, "other " * 300, shared[0] + " tail", "  " + shared[5]]
    edited = shared[5].split()
    edited[100] = "changed"
    texts += [" ".join(edited), "日本 🙂 " + shared[4]]
    source = [(i, t) for i, t, *_ in odd_rows()] + [(100 + i, t) for i, t in enumerate(texts)]
    df = docs(spark).unionByName(docs(spark, texts, first=100))
    for length in (50, 20):
        got = suffixes.repeated_passages(df, length=length).collect()
        assert sorted(((x["doc_id"], x["start_word"], x["end_word"]) for x in got), key=str) == brute(source, length)
        text_of = dict(source)
        for x in got:
            if x["doc_id"] is not None:
                t = text_of[x["doc_id"]]
                assert t[x["start_char"] : x["end_char"]].encode().split() == t.encode().split()[x["start_word"] : x["end_word"]]


def test_neighbours_over_the_ends_of_batches_and_tasks(spark):
    """Many tasks with one row a batch: most neighbours lie beyond an end."""
    r = random.Random(8)
    shared = [prose(700 + i, 70) for i in range(3)]
    texts = [f"{prose(i, r.randint(0, 30))} {shared[i % 3]} {prose(90 + i % 4, r.randint(0, 30))}" for i in range(24)]
    texts += [" ".join([shared[0]] * 6 + [prose(300, 9)] + [shared[0]] * 6), "a b " * 60, "a b " * 70 + "c"]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(keep, ("23", "1", "false")):
            spark.conf.set(k, v)
        got = suffixes.repeated_passages(docs(spark, texts)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted(((x["doc_id"], x["start_word"], x["end_word"]) for x in got), key=str) == brute(list(enumerate(texts)), 50)


def test_a_gap_between_the_longest_matches_is_settled(spark):
    """One text shares a long right side, another a long left side, a third the middle."""
    words = [f"w{i}" for i in range(100)]
    other = iter(f"x{i}" for i in range(10_000))

    def variant(a, b):
        return " ".join(w if a <= i < b else next(other) for i, w in enumerate(words))

    for cut in (20, 41):
        texts = [" ".join(words), variant(0, cut + 14), variant(cut, 100), variant(cut - 24, cut + 30)]
        got = suffixes.repeated_passages(docs(spark, texts)).collect()
        assert sorted(((x["doc_id"], x["start_word"], x["end_word"]) for x in got), key=str) == brute(list(enumerate(texts)), 50)


def test_empty_table(spark):
    assert suffixes.repeated_passages(no_docs(spark)).count() == 0
