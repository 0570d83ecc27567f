"""Structured Streaming versions of the stateful counters. Each gives what its batch twin gives on the same rows.

A stream's checkpoint lies in the shared scratch folder unless the caller names another; restarted with
the same checkpoint it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.usage import FREE_LIMIT, funnel_source
from paperloom.operators.usage import ORACLE_SQL as _BATCH_SQL
from paperloom.sources.scratch import scratch_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parquet*")


def funnel_counts(events: DataFrame) -> DataFrame:
    """Running counts by variant, event type and plan (complete mode)."""
    return events.groupBy("variant", "event_type", "plan").agg(F.count(F.lit(1)).alias("n"))


def daily_usage(calls: DataFrame, limit: int) -> DataFrame:
    """Running calls of an identity and day, and how many of them the limit allows (update or complete mode)."""
    return calls.groupBy("identity", "day").agg(F.count(F.lit(1)).alias("calls")).withColumn("used", F.least("calls", F.lit(limit).cast("long")))


def rate_limited_stream(calls: DataFrame, max_requests: int, window_seconds: float) -> DataFrame:
    """(id, identity, allowed) of each call, by a window that opens with a key's first call; calls of a batch are taken in order of time.

    A key's state is two numbers and is kept for good: a time-out would drop calls that come late.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["second", "id"])
        allowed = []
        for second in rows["second"]:
            if start is None or second - start >= window_seconds:
                start, used = second, 0
            allowed.append(used < max_requests)
            used += allowed[-1]
        state.update((start, used))
        yield pd.DataFrame({"id": rows["id"], "identity": key[0], "allowed": allowed})

    return calls.groupBy("identity").applyInPandasWithState(step, "id long, identity string, allowed boolean", "start double, used long", "append", GroupStateTimeout.NoTimeout)


def cache_stream(lookups: DataFrame, ttl_seconds: float) -> DataFrame:
    """(id, hash, hit): a hash is a hit for ``ttl_seconds`` after it was set; hits do not prolong it, the next miss sets it anew.

    A hash's state is one number and is kept for good: a time-out would drop lookups that come late.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["second", "id"])
        hits = []
        for second in rows["second"]:
            hit = since is not None and second - since <= ttl_seconds
            if not hit:
                since = second
            hits.append(hit)
        state.update((since,))
        yield pd.DataFrame({"id": rows["id"], "hash": key[0], "hit": hits})

    return lookups.groupBy("hash").applyInPandasWithState(step, "id long, hash string, hit boolean", "since double", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for the latest row of each key: a batch appends its own latest rows, and writes nothing else anew.

    A batch that is run again overwrites itself. Read the table with ``latest_rows``; ``compact`` folds it now and then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by partial aggregation."""
    at = F.struct(*order)
    whole = F.max_by(F.struct(*rows.columns), at)
    return rows.groupBy(*keys).agg(whole.alias("_row")).select("_row.*")


def latest_rows(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key over all batches; of equal ones the later batch's."""
    rows = spark.read.parquet(path)
    return _latest(rows, keys, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, to: str, keys: list[str], order: list[str]) -> None:
    """Folds all batches into the first batch of a new folder, for a stream that goes on there."""
    latest_rows(spark, path, keys, order).write.mode("overwrite").parquet(f"{to}/batch=-1")


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns its result as a table in the shared folder."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}" if mode == "append" else path)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/*" if mode == "append" else path)


def _calls(events: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("identity"), F.to_date("ts").alias("day"), seconds.alias("second"))


def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete counts after the last batch, from the same mapping as the batch funnel."""
    kind = F.create_map(*[F.lit(x) for p in (("view", "exposure"), ("purchase", "conversion"), ("signup", "trial_start")) for x in p])
    k = F.get_json_object("props", "$.k").cast("long")
    events = event_stream(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), kind[F.col("event_type")].alias("event_type"), F.concat(F.lit("plan"), (k % 3).cast("string")).alias("plan")).where("event_type IS NOT NULL")
    return drain(funnel_counts(events), "funnel", "complete")


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(daily_usage(_calls(event_stream(spark, sf_dir)), FREE_LIMIT), "quota", "complete")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls in any window of six hours, as in the batch query."""
    return drain(rate_limited_stream(_calls(event_stream(spark, sf_dir)), 3, 6 * 3600), "rate-limit", "append")


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by the props' content, kept for seven days."""
    lookups = event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.sha2("props", 256).alias("hash"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("second"))
    return drain(cache_stream(lookups, 7 * 86400), "cache", "append")


def batch_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_counts(funnel_source(spark, sf_dir))


QUERIES = {f.__name__: f for f in (stream_funnel, stream_quota, stream_rate_limit, stream_cache)}
ORACLE_SQL = {
    "stream_rate_limit": _BATCH_SQL["rate_limit"],
    "stream_funnel": "SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, CASE event_type WHEN 'view' THEN 'exposure' WHEN 'purchase' THEN 'conversion' ELSE 'trial_start' END AS event_type, 'plan' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS plan, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase', 'signup') GROUP BY ALL",
    "stream_quota": f"SELECT CAST(user_id AS VARCHAR) AS identity, CAST(ts AS DATE) AS day, count(*) AS calls, least(count(*), {FREE_LIMIT}) AS used FROM events GROUP BY ALL",
}
