"""SimHash near-duplicates, searched by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the majority of its 4-word shingles' XXH64 bits. Equal
fingerprints are collapsed first, so that copies cost one row. Each distinct fingerprint is cut into
three segments of at most 23 bits. A segment decodes, under the perfect binary Golay code (23, 12),
to its *home* codeword, and its *near* codewords are all those within 4 bits of it: one or six. Two
segments at most 1 bit apart have each other's homes among their near codewords.

With at most 4 errors in all, either two of the three segments have at most 1 error each, or one has
none (the pattern 0, 2, 2). So a fingerprint takes part under these keys, which together lose no link:

* for each pair of segments (a, b): (home a, near b) and (near a, home b);
* for each segment: its exact bits.

Fingerprints that share a key are compared by exact Hamming distance. Only a spanning forest of each
bucket's links goes on: a breadth-first search over the members not yet reached, never all pairs. A
bucket above ``block`` members is cut into blocks and every two blocks are searched by a task of their
own, so no task holds a whole bucket.

Nulls and empty texts have no shingle and fingerprint zero, which links like any other. A null id has
no order: a component of null ids alone has a null id. Extra columns are ignored; repeated rows each
give a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import components, persisted, unused

SEED = 42
#: Start and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the code.
GENERATOR = 0b101011100011


def text_fingerprint(text: str | None, words: int = 4) -> int:
    """Majority of the shingles' hash bits, most significant bit first."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - np.fromiter((len(w) + 1 for w in found), np.int64, len(found))).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], dtype=">u8").view(np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fp(F.col(text_col)).alias("fp"))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome the error patterns of at most 4 bits that give it, the lightest first, 0 where there are fewer than six."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    bit = np.array([syndrome(1 << i) for i in range(23)], dtype=np.int64)

    def of(n: int, shift: int) -> np.ndarray:
        values = np.arange(1 << n)
        out = np.zeros(1 << n, np.int64)
        for i in range(n):
            out ^= np.where(values >> i & 1, bit[i + shift], 0)
        return out

    low, high = of(12, 0), of(11, 12)
    patterns = np.zeros((2048, 6), np.int64)
    filled = np.zeros(2048, np.int64)
    filled[0] = 1
    level = [(0, 0, -1)]
    for weight in range(1, 5):
        level = [(e | 1 << i, s ^ int(bit[i]), i) for e, s, last in level for i in range(last + 1, 23)]
        for e, s, _ in level:
            # A word within 2 bits of a codeword has no other within 4; one at 3 bits has five at 4.
            if weight < 4 or int(patterns[s, 0]).bit_count() == 3:
                patterns[s, filled[s]] = e
                filled[s] += 1
    return low, high, patterns


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit words: the home codewords' 12-bit indices, the near ones' (n x 6), and which of these are real."""
    low, high, patterns = _tables()
    syndromes = low[values & 0xFFF] ^ high[values >> 12]
    errors = patterns[syndromes]
    near = (values[:, None] ^ errors) >> 11
    real = errors != 0
    real[:, 0] = True
    return near[:, 0], near, real


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, fingerprint) rows of fingerprints given as uint64."""
    cut = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    codes = [golay_keys(x) for x in cut]
    keys, owners = [], []
    me = np.arange(len(fps))
    for i, x in enumerate(cut):
        keys.append(x | (i << 32))
        owners.append(me)
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        home_a, near_a, real_a = codes[a]
        home_b, near_b, real_b = codes[b]
        for j in range(6):
            for key, real in (((home_a << 12) | near_b[:, j], real_b[:, j]), ((near_a[:, j] << 12) | home_b, real_a[:, j])):
                keys.append(key[real] | ((3 + k) << 32))
                owners.append(me[real])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[first], fps[owner[first]]


def bucket_forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected at ``bits`` or fewer among ``fps``; at most one less than there are."""
    left, found = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(left ^ at) <= bits
            if close.any():
                reached = left[close]
                found += [(at, x) for x in reached]
                queue += list(reached)
                left = left[~close]
    return found


def _bucket_links(bits: int):
    def run(frames):
        """Rows come sorted by key; a bucket may go over several frames."""
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(key: np.ndarray, fps: np.ndarray):
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
            sizes = ends - starts
            a, b = [], []
            small = np.repeat(sizes <= 16, sizes) & np.repeat(sizes > 1, sizes)
            k, f = key[small], fps[small]
            for d in range(1, 16):  # all small buckets at once, member i with member i + d
                if len(k) <= d:
                    break
                hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= bits) & (f[d:] != f[:-d])
                a.append(f[:-d][hit])
                b.append(f[d:][hit])
            for s, e in zip(starts[sizes > 16], ends[sizes > 16]):
                pairs = bucket_forest(np.unique(fps[s:e]), bits)
                if pairs:
                    a.append(np.array([x for x, _ in pairs], np.uint64))
                    b.append(np.array([x for _, x in pairs], np.uint64))
            if a and sum(map(len, a)):
                both = np.stack((np.concatenate(a), np.concatenate(b)), axis=1)
                both.sort(axis=1)
                both = np.unique(both, axis=0).view(np.int64)
                yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

        for frame in frames:
            key = np.concatenate((key, frame["key"].to_numpy(np.int64)))
            fps = np.concatenate((fps, frame["fp"].to_numpy(np.int64).view(np.uint64)))
            if len(key):
                whole = np.searchsorted(key, key[-1])
                if whole:
                    yield from links(key[:whole], fps[:whole])
                    key, fps = key[whole:], fps[whole:]
        if len(key):
            yield from links(key, fps)

    return run


def fingerprint_links(distinct: DataFrame, bits: int = 4, block: int = 50_000) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all that is connected at ``bits`` (at most 4)."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys cover up to 4 differing bits")

    def expand(frames):
        for frame in frames:
            all_fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for i in range(0, len(all_fps), 4096):
                key, fp = bucket_keys(all_fps[i : i + 4096])
                yield pd.DataFrame({"key": key, "fp": fp.view(np.int64)})

    rows = distinct.select("fp").mapInPandas(expand, "key long, fp long")
    large = persisted(rows.groupBy("key").count().where(F.col("count") > block), "large-buckets")
    if large.isEmpty():
        dealt, by = rows, ["key"]
    else:  # every two blocks of a large bucket meet in one task
        n = F.ceil(F.col("count") / block).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        dealt = rows.join(large, "key", "left").select("key", "fp", mine.alias("mine"), other.alias("other"))
        dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
        by = ["key"]
    return dealt.repartition(*by).sortWithinPartitions("key").mapInPandas(_bucket_links(bits), "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, text_links: DataFrame | None = None) -> DataFrame:
    """One row per document: (doc_id, text_hash, fp, root, component_id); root names the component by a fingerprint of it.

    ``text_links`` (a, b) are further links, between text hashes.
    """
    fps = persisted(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = persisted(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = fingerprint_links(firsts, bits)
    if text_links is not None:
        fp_of = fps.select("text_hash", "fp").distinct()
        links = links.union(text_links.join(fp_of.toDF("a", "fp_a"), "a").join(fp_of.toDF("b", "fp_b"), "b").select("fp_a", "fp_b"))
    groups = components(links, "a", "b", "fingerprint-links")
    member = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first_id")
    roots = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = member.join(roots, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return fps.join(label, fps["fp"] == label["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hex digits, component_id)."""
    return grouped(docs, id_col, text_col, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, text_links: DataFrame | None = None) -> DataFrame:
    """The document with the smallest id of each component (null ids last, then by text hash); same columns.

    ``text_links`` (a, b) are further links, between text hashes.
    """
    rows = persisted(grouped(docs, id_col, text_col, bits, text_links).select("doc_id", "text_hash", "root"), "fingerprint-groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    one_id, one_hash = unused(docs, "one_id", "one_hash")
    first = first.select(F.col("first.doc_id").alias(one_id), F.col("first.text_hash").alias(one_hash))
    twice = persisted(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(one_id), F.col("text_hash").alias(one_hash)), "repeated-rows")
    same = F.col(id_col).eqNullSafe(F.col(one_id)) & (F.xxhash64(text_col) == F.col(one_hash))
    kept = docs.join(first, same, "left_semi")
    if twice.isEmpty():
        return kept
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
