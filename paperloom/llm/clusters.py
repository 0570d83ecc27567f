"""Centroid clustering in exact integers, screened by block norms.

A vector becomes integers, floor(scale * x). It and each centroid are *compressed*: a segment of eight
components to its mean and the norm of what the mean leaves, both kept beside the vector in a written
table. By Cauchy-Schwarz the product of two segments is at most the product of their means (times eight)
plus the product of their norms, which gives a lower bound of the distance from 16 numbers instead of 64.
The centroid of the least bound gets its exact distance first. Any other gets one only if its bound, less
a margin for rounding, does not exceed the best exact distance so far. The bounds thus save work and never
decide: distances, ties (smaller number) and means are exact at any size.

A round reads the written table once. A task returns one row for each centroid and component, summed up
by Spark, so that the driver holds the centroids alone. Sums travel in four limbs of 40 bits.

Kept are vectors with exactly ``COMPONENTS`` components, none null, NaN or infinite, or 2^150 and more in
size. Others have no row. Repeated rows are vectors each for themselves. A null id never starts a
centroid before others do. Fewer vectors than centroids start fewer; an empty table gives no row. A
distance or a sum that exceeds a long is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import persisted

COMPONENTS, SEGMENTS = 64, 8
CENTROIDS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
#: Up to here 64 squared differences fit 64 bits.
_SMALL = 1 << 27
_LIMB = 40
_LONG = (1 << 63) - 1


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Rows of integers: int64, or Python's own where squares would not fit."""
    v = np.floor(flat.astype(np.float64) * scale).reshape(-1, COMPONENTS)
    return v.astype(np.int64) if not len(v) or np.abs(v).max() < _SMALL else np.frompyfunc(int, 1, 1)(v)


def compressed(v: np.ndarray) -> np.ndarray:
    """Per segment its mean, times the root of its width, and the norm of the rest: 2 x SEGMENTS numbers."""
    parts = v.astype(np.float64).reshape(len(v), SEGMENTS, -1)
    width = parts.shape[2]
    means = parts.mean(2)
    return np.hstack([means * np.sqrt(width), np.sqrt(((parts - means[:, :, None]) ** 2).sum(2))])


def nearest(v: np.ndarray, short: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's centroid, its squared distance, and how many centroids got an exact distance."""
    c = np.array(centroids, object)
    exact = v.dtype != object and max(map(abs, c.flat)) < _SMALL
    v, c = (v, c.astype(np.int64)) if exact else (v.astype(object), c)
    bounds = compressed(c)
    xx, cc = (short**2).sum(1), (bounds**2).sum(1)
    both = xx[:, None] + cc
    least = both - 2 * short @ bounds.T - both * 1e-12 - 1
    first = least.argmin(1)

    def distance(rows: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        gap = v[rows] - c[j]
        return (gap * gap).sum(1)

    cluster, n_exact = first.copy(), np.ones(len(v), np.int32)
    best = distance(np.arange(len(v)), first)
    for j in range(len(c)):
        rows = np.flatnonzero((first != j) & (least[:, j] <= best.astype(np.float64)))
        n_exact[rows] += 1
        d = distance(rows, j)
        won = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        cluster[rows[won]], best[rows[won]] = j, d[won]
    return cluster, best, n_exact


def _read(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    v = integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False), scale)
    return v, batch.column("short").flatten().to_numpy().reshape(len(v), -1)


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The kept vectors (id, vector) with their compressed form (short), written and read back."""
    x = F.col(vector_col)
    sound = (F.size(x) == COMPONENTS) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) < F.lit(2.0**150 / scale)))
    kept = vectors.where(sound).select(F.col(id_col).alias("id"), x.alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = compressed(integers(b.column("vector").flatten().to_numpy(zero_copy_only=False), scale))
            ends = pa.array(np.arange(0, short.size + 1, 2 * SEGMENTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(short.ravel()))], ["id", "vector", "short"])

    return persisted(kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("short", T.ArrayType(T.DoubleType()))])), "vectors")


def start(prepared: DataFrame, k: int = CENTROIDS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors whose id has the smallest hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [[int(y) for y in integers(np.array(r["vector"]), scale)[0]] for r in prepared.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()]


def means(prepared: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """One round: the floor of the mean of each centroid's vectors; a centroid without any stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * len(centroids), np.zeros((len(centroids), COMPONENTS), object)
        for b in batches:
            v, short = _read(b, scale)
            cluster = nearest(v, short, centroids)[0]
            for j in np.unique(cluster):
                own = v[cluster == j]
                n[j] += len(own)
                sums[j] += own.sum(0)
        rows = [(j, i, n[j], *[int(s) >> _LIMB * k & (1 << _LIMB) - 1 for k in range(3)], int(s) >> 3 * _LIMB) for j in range(len(centroids)) if n[j] for i, s in enumerate(sums[j])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], list("jinabcd"))

    total = prepared.mapInArrow(run, "j long, i long, n long, a long, b long, c long, d long").groupBy("j", "i").agg(*[F.sum(x).alias(x) for x in "nabcd"])
    out = [list(c) for c in centroids]
    for r in total.collect():  # centroids x components
        out[r["j"]][r["i"]] = (r["a"] + (r["b"] << _LIMB) + (r["c"] << 2 * _LIMB) + (r["d"] << 3 * _LIMB)) // r["n"]
    return out


def assign(prepared: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, cluster, distance and n_exact, the number of centroids the bounds left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, short = _read(b, scale)
            cluster, d, n_exact = nearest(v, short, centroids)
            if d.dtype == object:
                d = [x if x <= _LONG else None for x in d]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster.astype(np.int32)), pa.array(d, pa.int64()), pa.array(n_exact)], ["id", "cluster", "distance", "n_exact"])

    schema = T.StructType([prepared.schema["id"], *[T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("n_exact", T.IntegerType()))]])
    return prepared.mapInArrow(run, schema)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """``assign`` after ``rounds`` rounds, written, and the final centroids."""
    prepared = prepare(vectors, id_col, vector_col, scale)
    centroids = start(prepared, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = means(prepared, centroids, scale)
    return persisted(assign(prepared, centroids, scale), "clusters"), centroids


def digest(assigned: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """Per vector: cluster, distance, the sums over its cluster and over all, a hash of its centroid."""
    sums = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    found = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in sums}  # at most one row per centroid
    total = None if None in found.values() else sum(found.values())

    def long(x: int | None) -> int | None:
        return x if x is not None and x <= _LONG else None

    rows = [(j, long(s), long(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in found.items()]
    said = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", id_col).join(F.broadcast(said), "cluster")
