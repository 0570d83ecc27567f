"""Near copies by five-word shingles: MinHash proposes pairs, the exact Jaccard similarity decides.

A text's shingles are the distinct runs of five lower-cased words (a shorter text is one shingle), each a
64-bit hash. 120 MinHash values form 24 keys of five, so two texts of similarity 0.8 share a key with
probability 0.9999 and more alike ones surely. Equal texts are one node.

A key pairs its nodes with one of them first, the same one for keys of the same nodes. Keys of three nodes or more
that this leaves in more than one piece are gathered: whatever they connect is a group, whose sets are brought
together once. There an inverted index counts what two nodes have in common, nodes that share too little with all
others are left out beforehand, and a spanning forest of the alike ones is returned. So two alike nodes with a key
in common are always connected, and no pair of a group becomes a row. A group of more than ``BLOCK`` shingles is
dealt into blocks, of which every two meet. Pairs below the similarity are left out. Nulls and texts without a word have no
shingle and link to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import components, persisted

BANDS, ROWS, SEED = 24, 5, 42
#: Shingles of a group that a task holds, twice.
BLOCK = 1_000_000
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1))


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        x = found[i : i + 512, None] * _MULTIPLIERS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=0), out=least)
    rows = np.concatenate((np.arange(BANDS, dtype=np.uint64)[:, None], least.reshape(BANDS, ROWS)), axis=1)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), np.uint64, BANDS).view(np.int64)


def alike_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` (of distinct numbers each) that connect whatever is connected by pairs ``similarity`` alike or more."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    while True:  # what only one has goes, and then those that have too little left
        often = np.bincount(flat, minlength=1)[flat] > 1
        enough = np.bincount(owner[often], minlength=n) >= similarity * sizes
        stay = often & enough[owner]
        if stay.all():
            break
        flat, owner = flat[stay], owner[stay]
    holders = owner[np.argsort(flat, kind="stable")]
    until = np.cumsum(np.bincount(flat, minlength=1))
    since = np.concatenate(([0], until[:-1]))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    left = np.diff(bounds) > 0
    found = []
    for first in np.flatnonzero(left).tolist():
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            at = queue.pop()
            own = flat[bounds[at] : bounds[at + 1]]
            common = np.bincount(np.concatenate([holders[a:b] for a, b in zip(since[own].tolist(), until[own].tolist())]), minlength=n)
            reached = np.flatnonzero(left & (common >= similarity * (sizes[at] + sizes - common))).tolist()
            left[reached] = False
            found += [(at, x) for x in reached]
            queue += reached
    return found


def _in_groups(similarity: float):
    """Rows (group, node, set), sorted by group, to the links (a, b) within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            pairs = alike_forest(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for g, node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != group:
                    if len(nodes) > 1:
                        yield out()
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(own.values.to_numpy())
        if len(nodes) > 1:
            yield out()

    return run


def links_in_groups(sets: DataFrame, groups: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all alike nodes of each group. ``sets`` has (node, set), ``groups`` (node, component)."""
    rows = sets.join(groups.withColumnRenamed("component", "group"), "node")
    blocks = groups.join(sets.select("node", F.size("set").alias("size")), "node").groupBy(F.col("component").alias("group")).agg(F.ceil(F.sum("size") / block).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = rows.join(blocks, "group").select("group", "node", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "node", "set")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_in_groups(similarity), "a long, b long")


def stars(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """Distinct pairs (a, b), a < b: each node of rows (key, node) and the least one of its key and bucket, and these and the least of the key."""
    dealt = rows.select("key", "node", F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket"))
    centres = dealt.groupBy("key", "bucket").agg(F.min("node").alias("centre"))
    tops = centres.groupBy("key").agg(F.min("centre").alias("top"))
    within = dealt.join(centres, ["key", "bucket"]).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return within.union(centres.join(tops, "key").select(F.col("top").alias("a"), F.col("centre").alias("b"))).where("a < b").distinct()


def links(docs: DataFrame, text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(a, b): hashes of distinct texts that are ``similarity`` alike or more, enough of them to connect all such texts that share a key."""

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        found = (shingles(x) for x in texts)
        return pd.Series([band_keys(x) if len(x) else np.zeros(0, np.int64) for x in found], dtype=object)

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).view(np.int64) for x in texts], dtype=object)

    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    rows = persisted(texts.select("node", keys(F.col("text")).alias("keys")).dropDuplicates(["node"]), "band-keys")
    bands = rows.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = persisted(bands.join(shared, "key"), "shared-keys")
    pairs = persisted(stars(shared), "star-pairs")
    asked = shared.select("node").distinct()
    held = persisted(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]).select("node", sets(F.col("text")).alias("set")), "shingle-sets")
    a, b = (held.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    least, most = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(a, "a").join(b, "b").where(least >= similarity * most)
    near = persisted(both.where(common >= similarity * (F.size("set_a") + F.size("set_b") - common)).select("a", "b"), "near-copies")

    roots = components(near, "a", "b", "near-so-far")
    rooted = shared.where("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("node").alias("least")).where("r <> s").select("key", "least")
    groups = components(rooted.join(apart, "key").select("least", "node"), "least", "node", "near-groups")
    return near.union(persisted(links_in_groups(held, groups, similarity), "near-copies"))
