import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import common, linededup


def smallest_reachable(links):
    name = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    return name


def shuffled(n, seed):
    x = list(range(n))
    random.Random(seed).shuffle(x)
    return x


@pytest.mark.parametrize("links", [list(zip(shuffled(40, 1), shuffled(40, 1)[1:])), [(50, i) for i in range(50)], [(i, i * i % 61) for i in range(61)]], ids=["path", "hub", "squares"])
def test_components_equal_brute_force(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    expected = sorted(smallest_reachable(links).items())
    assert sorted(map(tuple, common.components(df, "a", "b").collect())) == expected
    assert sorted(map(tuple, common.with_centres(common.star_links(df, "a", "b", written=True)).collect())) == expected


def test_steps_over_few_links_are_few_files(spark, monkeypatch):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    steps, persisted = [], common.persisted
    monkeypatch.setattr(common, "persisted", lambda *a: steps.append(persisted(*a)) or steps[-1])
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = shuffled(300, 2)
        found = common.components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"), "a", "b")
        assert found.where("component = 0").count() == 300
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(steps) > 2
    assert all(len(step.inputFiles()) <= spark.sparkContext.defaultParallelism for step in steps[1:])


def test_links_of_line_copies_are_followed_once(spark, monkeypatch):
    written, persisted = [], common.persisted
    monkeypatch.setattr(common, "persisted", lambda df, name, *a: written.append(name) or persisted(df, name, *a))
    line = lambda i: i * 256 + 8
    # 150 documents share one line; 70 of them have all but one line in common, and as many others.
    sets = [[line(0), *[line(1 + k) for k in range(4)], line(1000 + i)] for i in range(70)]
    sets += [[line(0), *[line(11 + k) for k in range(4)], line(2000 + i)] for i in range(70)]
    sets += [[line(0), *[line(5000 + 9 * i + k) for k in range(5)]] for i in range(10)]
    df = spark.createDataFrame(list(enumerate(sets)), "node long, set array<long>").select("node", F.sort_array("set").alias("set"))
    found = dict(map(tuple, linededup.copy_groups(df, 0.5).collect()))
    assert found == {i: i // 70 * 70 for i in range(140)}
    # One write of links for each set of keys, and none for links that were followed before.
    assert written.count("line-copies") == written.count("line-copies-pairs")
