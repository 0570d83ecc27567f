"""Vector bin packing of documents into shards: bytes, tokens and rows balanced jointly.

Documents of equal text form a group, placed whole, with the vector (bytes, tokens, rows). A group is
placed in the shard where the dot product of its vector and the shard's residual capacity is highest,
among the shards with room; both are taken as shares of a shard's capacity, and larger groups go first.

Two steps keep this distributed:

* A group above ``1 / heavy`` of a shard in some measure is heavy. There are at most 3 * heavy * shards
  of them however large the corpus is, so they are placed first, in one list. A group above half a
  shard is cut into pieces of at most a quarter of a shard, as many for each shard, by a gapless rank
  of its rows: no shard could hold it beside its share of the rest.
* The light groups are dealt by hash into cells. A cell places its groups by the same rule, its share
  of the residual capacity being the capacity; each cell is thus balanced, and so is their sum. A cell
  holds about ``cell`` group vectors, so the number of cells grows with the corpus.

The law is ``bytes``: sizes near equal. Slots count from 0 without gaps within a shard. A single text of
more than a shard's bytes is not cut: its shard then holds it, and whatever else the rule gives it.

A null text has no bytes and forms one group, with size 1. Empty tables give no rows. Repeated rows and
repeated or null ids are rows like any others: ranks are dealt by the rows' places in a written table. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, parts, persisted, spread_rank

MEASURES = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, residual: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """A shard for each vector; ``residual`` (shards x measures) is used up. Ties go to the lower shard."""
    share = vectors / capacity
    left = residual / capacity
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        v = share[i]
        score = left @ v
        fits = (left >= v).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        k = int(np.argmax(score))
        out[i] = k
        left[k] -= v
    residual[:] = left * capacity
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, cell: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.unhex(F.md5(F.encode(text, "UTF-8"))), F.lit(b"")).alias("group"),
    )
    # Numbers the written rows: ranks do not depend on ids, which may repeat.
    rows = persisted(rows.withColumn("row", F.monotonically_increasing_id()), "document-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = persisted(rows.groupBy("group").agg(*sums), "text-groups")
    total = groups.agg(*[F.sum(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("groups")).first()
    capacity = np.array([max(total[m] or 0, 1) / shards for m in MEASURES])

    # Heavy groups, cut where they are larger than half a shard. Bounded by 3 * (heavy + 2 * shards) * shards rows, plus four a shard.
    is_heavy = F.greatest(*[F.col(m) / float(c) for m, c in zip(MEASURES, capacity)])
    weights = groups.withColumn("share", is_heavy)
    big = weights.where(F.col("share") > 1 / heavy)
    cut = big.select("group", F.when(F.col("share") > 0.5, shards * F.ceil(F.col("share") * 4 / shards)).otherwise(1).cast("int").alias("pieces"))
    of = persisted(rows.join(F.broadcast(cut), "group"), "heavy-documents")
    of = spread_rank(of, ["group"], ["row"], "rank", parts(docs.sparkSession))
    of = persisted(of.withColumn("piece", (F.col("rank") % F.col("pieces")).cast("int")).drop("rank", "pieces"), "heavy-pieces")
    heavies = of.groupBy("group", "piece").agg(*sums).orderBy("group", "piece").toPandas()
    residual = np.tile(capacity, (shards, 1))
    heavies["shard"] = place(heavies[list(MEASURES)].to_numpy(float).reshape(-1, 3), residual, capacity)

    # Light groups, cell by cell, each with its share of what is left.
    light = weights.where(F.col("share") <= 1 / heavy).drop("share")
    cells = max(1, -(-int(total["groups"] or 0) // cell))
    room = residual / cells

    def place_cell(frame: pd.DataFrame) -> pd.DataFrame:
        # By hash, not by size: groups that only rows make equal must come mixed, or bytes end uneven.
        frame = frame.sort_values("group")
        vectors = frame[list(MEASURES)].to_numpy(float)
        # Scaled to this cell's own sums, so that every cell fills all shards in step.
        want = room * (vectors.sum(axis=0) / np.maximum(room.sum(axis=0), 1e-9))
        shards_of = place(vectors, want, np.maximum(want.mean(axis=0), 1e-9))
        return pd.DataFrame({"group": frame["group"], "shard": shards_of})

    dealt = light.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
    lights = dealt.groupBy("cell").applyInPandas(place_cell, "group binary, shard int")

    spark = docs.sparkSession
    placed = spark.createDataFrame(heavies[["group", "piece", "shard"]].astype({"piece": "int32", "shard": "int32"}), "group binary, piece int, shard int")
    columns = ["doc_id", "size", "text_crc32", "n_tokens", "row", "shard"]
    of_heavy = of.join(F.broadcast(placed), ["group", "piece"]).select(*columns)
    of_light = rows.join(F.broadcast(cut.select("group")), "group", "left_anti").join(lights, "group").select(*columns)
    done = persisted(of_heavy.unionByName(of_light), "placed-documents")
    ranked = spread_rank(done, ["shard"], ["row"], "slot", parts(spark))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
