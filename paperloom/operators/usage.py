"""Operational queries: funnel, latency rollups, quotas, sync, audit chain, dead letters, chat, library, dashboard.

The fixtures hold no application tables, so ``events``, ``conversations``, ``documents`` and others stand
in; each ``*_source`` function states the mapping. The operators themselves take any frame of the
named columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ZEROS = "0" * 64
#: Daily limits and the tiers without one.
FREE_LIMIT, BASIC_LIMIT, TEAM_LIMIT_MAX = 15, 100, 1000
UNLIMITED = ("monthly", "yearly", "lifetime")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Funnel


def normalised_funnel(events: DataFrame) -> DataFrame:
    """Variants are trimmed and upper-cased, others than A and B count as A; unknown event types as conversions."""
    variant = F.upper(F.trim("variant"))
    return events.withColumn("variant", F.when(variant.isin("A", "B"), variant).otherwise("A")).withColumn("event_type", F.when(F.col("event_type").isin("exposure", "conversion", "trial_start"), F.col("event_type")).otherwise("conversion"))


def funnel(events: DataFrame) -> DataFrame:
    """One row for A and one for B: exposure, conversions, trials and the two rates in percent (0 without exposure)."""
    counts = events.where(F.col("variant").isin("A", "B")).groupBy("variant").agg(*[F.count_if(F.col("event_type") == k).alias(c) for k, c in (("exposure", "exposure"), ("conversion", "conversions_total"), ("trial_start", "trials"))])
    both = events.sparkSession.createDataFrame([("A",), ("B",)], "variant string")
    full = both.join(counts, "variant", "left").na.fill(0)

    def rate(n: str) -> Column:
        return F.when(F.col("exposure") > 0, F.round(F.col(n) / F.col("exposure") * 100, 2)).otherwise(0.0)

    return full.withColumn("cvr", rate("conversions_total")).withColumn("trial_cvr", rate("trials"))


def funnel_plans(events: DataFrame) -> DataFrame:
    """Conversions by variant and plan; the plan may be null."""
    return events.where("event_type = 'conversion'").groupBy("variant", "plan").agg(F.count(F.lit(1)).alias("conversions"))


def funnel_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view: exposure, purchase: conversion, signup: trial start; variant by user, plan by the props' k."""
    e = _t(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in (("view", "exposure"), ("purchase", "conversion"), ("signup", "trial_start")) for x in pair])
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("ts", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), kind[F.col("event_type")].alias("event_type"), F.concat(F.lit("plan"), (k % 3).cast("string")).alias("plan")).where("event_type IS NOT NULL")


def funnel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(funnel_source(spark, sf_dir))


def funnel_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_plans(funnel_source(spark, sf_dir))


# Latency


def routed(events: DataFrame, max_routes: int) -> DataFrame:
    """Events by route: only the first ``max_routes`` routes by their first event have a name; the others share ``(other)``."""
    first = events.groupBy("route").agg(F.min("seq").alias("first_seq"))
    named = first.orderBy("first_seq").limit(max_routes).select("route", F.lit(True).alias("named"))
    return events.join(named, "route", "left").withColumn("route", F.when(F.col("named"), F.col("route")).otherwise("(other)")).drop("named")


def kept_events(events: DataFrame, per_route: int = 100, max_routes: int = 200) -> DataFrame:
    """The last ``per_route`` events of each route."""
    order = Window.partitionBy("route").orderBy(F.desc("seq"))
    return routed(events, max_routes).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_route)


def route_rollup(events: DataFrame, per_route: int = 100, max_routes: int = 200) -> DataFrame:
    """Per route over what it keeps: count, mean and maximum of p95, slow rate in percent, last event."""
    return kept_events(events, per_route, max_routes).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("p95"), 2).alias("avg_p95"),
        F.max("p95").alias("max_p95"),
        F.round(F.avg(F.col("slow").cast("double")) * 100, 2).alias("slow_rate"),
        F.max("seq").alias("last_seq"),
    )


def perf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("route"), F.col("value").alias("p95"), (F.col("event_type") == "error").alias("slow"))


def perf_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_rollup(perf_source(spark, sf_dir))


def perf_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the reported p95 values over what the routes keep, and slow frames among the last 1000 events."""
    e = perf_source(spark, sf_dir)
    kept = kept_events(e)
    recent = e.orderBy(F.desc("seq")).limit(1000)
    return kept.agg(F.round(F.avg("p95"), 2).alias("overall_avg_p95"), F.count(F.lit(1)).alias("total_events")).crossJoin(recent.agg(F.count_if("slow").alias("recent_slow_frames")))


def perf_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf_source(spark, sf_dir).orderBy(F.desc("seq")).limit(50)


# Quotas


def daily_quota(calls: DataFrame, limit: Column) -> DataFrame:
    """Adds nth (the call's place in its identity's day), allowed, used and remaining; refused calls do not count."""
    nth = F.row_number().over(Window.partitionBy("identity", "day").orderBy("ts", "id")).cast("long")
    out = calls.withColumn("nth", nth).withColumn("limit", limit.cast("long"))
    out = out.withColumn("allowed", F.col("limit").isNull() | (F.col("nth") <= F.col("limit")))
    used = F.when(F.col("limit").isNull(), F.col("nth")).otherwise(F.least("nth", "limit"))
    return out.withColumn("used", used).withColumn("remaining", F.when(F.col("limit").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("nth"))))


def tier_limit(tier: Column) -> Column:
    """Calls a day: null is unlimited."""
    return F.when(tier.isin(*UNLIMITED), F.lit(None)).when(tier == "basic", BASIC_LIMIT).otherwise(FREE_LIMIT)


def calls_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("identity"), F.to_date("ts").alias("day"), "ts")


def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_quota(calls_source(spark, sf_dir), F.lit(FREE_LIMIT)).select("id", "identity", "nth", "allowed", "used", "remaining")


def quota_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier by user: free, basic, monthly, lifetime in turn."""
    tiers = F.array(*[F.lit(x) for x in ("free", "basic", "monthly", "lifetime")])
    calls = calls_source(spark, sf_dir).withColumn("tier", F.get(tiers, F.col("identity").cast("int") % 4))
    return daily_quota(calls, tier_limit(F.col("tier"))).groupBy("tier").agg(F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed"))


def quota_team_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users share their team's pool; a team's own quota counts up to the maximum."""
    calls = calls_source(spark, sf_dir).withColumn("team", F.col("identity").cast("long") % 5).withColumn("identity", F.concat(F.lit("team:"), F.col("team").cast("string")))
    return daily_quota(calls, F.least((F.col("team") + 1) * 40, F.lit(TEAM_LIMIT_MAX))).groupBy("identity").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def rate_limited(calls: DataFrame, max_requests: int, window_seconds: float) -> DataFrame:
    """(id, identity, allowed): a window opens with a key's first call and again with the first call after it closed.

    Where a window opens depends on all calls before it, so each key's calls are taken in order: keys are
    dealt, sorted and read as a stream of batches. A task holds one batch and one window, however many
    calls a key has.
    """
    import pandas as pd

    def run(frames):
        key, start, used = None, None, 0
        for f in frames:
            allowed = []
            for identity, second in zip(f["identity"], f["second"]):
                if identity != key or second - start >= window_seconds:
                    key, start, used = identity, second, 0
                allowed.append(used < max_requests)
                used += allowed[-1]
            yield pd.DataFrame({"id": f["id"], "identity": f["identity"], "allowed": allowed})

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = calls.select("id", "identity", seconds.alias("second")).repartition("identity").sortWithinPartitions("identity", "second", "id")
    return rows.mapInPandas(run, "id long, identity string, allowed boolean")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls in any window of six hours."""
    return rate_limited(calls_source(spark, sf_dir), 3, 6 * 3600)


# Sync


def latest_versions(ops: DataFrame) -> DataFrame:
    """Per owner and file: version (pushes so far), whether the last operation deleted it, last blank-free device."""
    last = F.max_by(F.col("op"), F.struct("ts", "id"))
    device = F.max_by(F.col("device"), F.when((F.col("op") == "push") & (F.coalesce(F.col("device"), F.lit("")) != ""), F.struct("ts", "id")))
    return ops.groupBy("owner", "file").agg(F.count_if(F.col("op") == "push").alias("version"), (last == "delete").alias("deleted"), device.alias("device"), F.max("ts").alias("updated_at"), F.max_by("size", F.struct("ts", "id")).alias("size"))


def sync_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors delete, other events push; the file is the props' k modulo 7, the device blank for clicks."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("owner"), (k % 7).alias("file"), F.when(F.col("event_type") == "error", "delete").otherwise("push").alias("op"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("device"), F.col("value").alias("size"))


def sync_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(sync_source(spark, sf_dir)).where(~F.col("deleted")).drop("deleted")


def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = latest_versions(sync_source(spark, sf_dir)).where(~F.col("deleted"))
    return live.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size"), 4).alias("total_size"))


# Audit


def audit_chain_rows(log: DataFrame) -> DataFrame:
    """Adds prev_hash and hash = sha256(prev|action|target|detail|time) to each team's log, in order.

    Each hash needs the one before it, so teams are dealt, sorted and read as a stream of batches. A task
    holds one batch and one hash, however long a team's log is.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        key, before = None, ZEROS
        for batch in batches:
            prev, own = [], []
            for team, payload in zip(batch["key"].to_pylist(), batch["payload"].to_pylist()):
                if team != key:
                    key, before = team, ZEROS
                prev.append(before)
                before = hashlib.sha256(f"{before}|{payload}".encode()).hexdigest()
                own.append(before)
            yield pa.RecordBatch.from_arrays([batch["team"], batch["id"], pa.array(prev, pa.string()), pa.array(own, pa.string())], names=["team", "id", "prev_hash", "hash"])

    payload = F.concat_ws("|", F.coalesce("action", F.lit("")), F.coalesce("target", F.lit("")), F.coalesce("detail", F.lit("")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    key = F.concat(F.lit("t"), F.coalesce(F.col("team").cast("string"), F.lit("")), F.col("team").isNull().cast("string"))
    rows = log.select("team", F.col("id").cast("long").alias("id"), key.alias("key"), "ts", payload.alias("payload"))
    rows = rows.repartition("key").sortWithinPartitions("key", "ts", "id", "payload").drop("ts")
    return rows.mapInArrow(run, StructType([log.schema["team"], StructField("id", LongType()), StructField("prev_hash", StringType()), StructField("hash", StringType())]))


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows whose prev_hash is not the previous row's hash (zeros for the first)."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("team").orderBy("ts", "id")), F.lit(ZEROS))
    return chain.withColumn("expected", before).where(~F.col("prev_hash").eqNullSafe(F.col("expected")))


def cef_escape(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("=", "\\=")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def cef_lines(log: DataFrame) -> Column:
    parts = [F.lit("src="), cef_escape(F.col("actor").cast("string")), F.lit(" dst="), cef_escape(F.col("team").cast("string")), F.lit(" act="), cef_escape(F.col("action")), F.lit(" target="), cef_escape(F.col("target")), F.lit(" msg="), cef_escape(F.col("detail"))]
    head = [F.lit("CEF:0|paperloom|audit|1.0|"), cef_escape(F.col("action")), F.lit("|"), cef_escape(F.col("action")), F.lit("|5|")]
    return F.concat(*head, *parts)


def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team per user; every tenth event links to a wrong predecessor in ``audit_verify``."""
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 5).alias("team"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.concat(F.lit("doc=|"), (F.col("event_id") % 11).cast("string")).alias("target"), F.col("props").alias("detail"))


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user."""
    return audit_chain_rows(audit_source(spark, sf_dir).withColumn("team", F.col("actor")))


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_source(spark, sf_dir)
    order = Window.partitionBy("team").orderBy("ts", "id")
    own = F.sha2(F.concat(F.col("id").cast("string"), F.lit("|"), F.col("action")), 256)
    chain = log.withColumn("hash", own).withColumn("prev_hash", F.when(F.col("id") % 10 == 9, "bad").otherwise(F.coalesce(F.lag("hash").over(order), F.lit(ZEROS))))
    return broken_links(chain).groupBy("team").agg(F.count(F.lit(1)).alias("tampered"), F.min("id").alias("first_id"))


def audit_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_source(spark, sf_dir)
    return log.select("id", cef_lines(log).alias("line"))


# Collaboration


def collab_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 commands of each team and file stay."""
    log = audit_source(spark, sf_dir).withColumn("file", F.col("id") % 2)
    r = F.row_number().over(Window.partitionBy("team", "file").orderBy(F.desc("ts"), F.desc("id")))
    return log.withColumn("r", r).where("r <= 1000").groupBy("team", "file").agg(F.count(F.lit(1)).alias("kept"), F.min("id").alias("oldest_id"))


def collab_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On connecting, the oldest 100 commands of the team's file, in order."""
    r = F.row_number().over(Window.partitionBy("team").orderBy("ts", "id"))
    return audit_source(spark, sf_dir).withColumn("place", r.cast("long")).where("place <= 100").select("team", "place", "id", "action")


def collab_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 commands, oldest first."""
    newest = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("ts"), F.desc("id")))
    kept = audit_source(spark, sf_dir).withColumn("r", newest).where("r <= 20")
    place = F.row_number().over(Window.partitionBy("team").orderBy("ts", "id"))
    return kept.select("team", "id", place.cast("long").alias("place"))


# Dead letters


def dead_letters(attempts: DataFrame, hooks: DataFrame, failed: int = 100, inactive: int = 20) -> DataFrame:
    """Newest failed attempts of known webhooks, then newest inactive webhooks not among them."""
    newest = attempts.where(~F.col("success")).orderBy(F.desc("ts"), F.desc("attempt_id")).limit(failed)
    reason = F.substring(F.concat(F.lit("delivery_failed: "), F.col("event_type"), F.lit(" status="), F.col("status").cast("string"), F.lit(" error="), F.coalesce("error", F.lit(""))), 1, 500)
    of_failed = newest.join(hooks, "hook_id").select("hook_id", "url", "active", reason.alias("reason"), "attempt_id")
    off = hooks.where(~F.col("active")).orderBy(F.desc("hook_id")).limit(inactive).join(of_failed.select("hook_id").distinct(), "hook_id", "left_anti")
    of_off = off.select("hook_id", "url", "active", F.lit("inactive_or_delivery_failed").alias("reason"), F.lit(None).cast("long").alias("attempt_id"))
    return of_failed.unionByName(of_off)


def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts: events, errors failed; webhooks: suppliers, every third inactive."""
    attempts = _t(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), "ts", (F.col("user_id") * 3).alias("hook_id"), "event_type", (F.col("event_type") != "error").alias("success"), (F.lit(500) + F.col("event_id") % 4).alias("status"), F.when(F.col("event_id") % 2 == 0, "timeout").alias("error"))
    hooks = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hook_id"), F.concat(F.lit("https://example.com/"), F.col("s_name")).alias("url"), (F.col("s_suppkey") % 3 != 0).alias("active"))
    return dead_letters(attempts, hooks)


def dlq_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred entries, failed attempts before inactive webhooks, and the count of all beside each."""
    all_of = dlq(spark, sf_dir).withColumn("late", F.col("attempt_id").isNull())
    count = all_of.agg(F.count(F.lit(1)).alias("dlq_count"))
    return all_of.orderBy("late", F.desc("attempt_id"), F.desc("hook_id")).limit(100).drop("late").crossJoin(F.broadcast(count))


# Chat


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its message count, zero included, and the next sequence number."""
    messages = _t(spark, sf_dir, "conversations")
    sessions = messages.select("conv_id").distinct().union(spark.range(1).select((F.col("id") - 1).alias("conv_id")))
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last"))
    return sessions.join(counts, "conv_id", "left").select("conv_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), (F.coalesce("last", F.lit(0)) + 1).alias("next_seq"))


def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages of each session, oldest first."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = _t(spark, sf_dir, "conversations").withColumn("r", newest).where("r <= 10")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.select("conv_id", place.cast("long").alias("place"), "role", "text")


# Documents, library, dashboard


def doc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20, newest first, with the total."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.orderBy(F.desc("doc_id")).offset(40).limit(20).crossJoin(docs.agg(F.count(F.lit(1)).alias("total")))


def doc_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels nested, as one line of text."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("name"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("value")))).alias("field"))
    nested = labels.groupBy("doc_id").agg(F.sort_array(F.collect_list("field")).alias("fields"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source").join(nested, "doc_id", "left")
    lines = F.transform(F.coalesce("fields", F.array().cast("array<struct<name:string,value:int>>")), lambda f: F.concat_ws("=", f["name"], f["value"].cast("string")))
    return docs.select("doc_id", "source", F.array_join(lines, ";").alias("fields"))


def library(items: DataFrame, folder: str | None = None, kind: str | None = None, favorites: bool = False, tags: list[str] | None = None, search: str | None = None, sort_by: str = "modified", descending: bool = True) -> DataFrame:
    """Items that pass every filter, with their place: pinned first, then by the field, ties by name ascending."""
    if folder is not None:
        items = items.where(F.col("folder") == folder)
    if kind is not None:
        items = items.where(F.col("kind") == kind)
    if favorites:
        items = items.where("favorite")
    if tags:
        items = items.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if search and search.strip():
        needle = search.lower().strip()
        items = items.where(F.lower("name").contains(needle) | F.exists("tags", lambda t: F.lower(t).contains(needle)))
    key = {"name": F.lower("name"), "modified": F.col("modified"), "size": F.col("size"), "opened": F.coalesce("opened", "created")}[sort_by]
    order = [F.desc("pinned"), key.desc() if descending else key.asc(), F.col("name")]
    return items.orderBy(*order)


def library_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.col("source").alias("folder"),
        F.col("lang").alias("kind"),
        F.array(F.col("lang"), F.concat(F.lit("Tag"), (F.col("doc_id") % 5).cast("string"))).alias("tags"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("favorite"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pinned"),
        (F.col("doc_id") * 7919 % 1000).alias("modified"),
        F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 31 % 500).alias("opened"),
        (F.col("doc_id") % 400).alias("created"),
    )


LIBRARY_QUERIES = {
    "library_default": {},
    "library_size_asc": {"sort_by": "size", "descending": False, "kind": "en"},
    "library_tag": {"tags": ["Tag1", "Tag3"], "sort_by": "name", "descending": False},
    "library_search": {"search": " TAG2 ", "sort_by": "opened"},
    "library_favorites": {"favorites": True, "folder": "src0"},
}


def _library_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return library(library_source(spark, sf_dir), **LIBRARY_QUERIES[name]).select("doc_id", "name", "pinned")

    run.__name__ = name
    return run


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over each table."""
    e = _t(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))
    d = _t(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n_chars") > 12000).alias("long_documents"))
    c = _t(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("sessions"), F.count(F.lit(1)).alias("messages"))
    return e.crossJoin(d).crossJoin(c)


def content_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by content hash in order of id: the first is a miss, later ones are hits."""
    docs = _t(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    n = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("misses"), F.sum(F.col("n") - 1).alias("hits"))
    return n.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")) * 100, 1))


def active_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, not free, and lifetime or not yet expired."""
    o = _t(spark, sf_dir, "orders")
    tiers = F.array(*[F.lit(x) for x in ("free", "basic", "monthly", "lifetime")])
    ent = o.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("valid"), F.get(tiers, (F.col("o_orderkey") % 4).cast("int")).alias("tier"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderdate")).alias("expiry"))
    active = F.col("valid") & (F.col("tier") != "free") & ((F.col("tier") == "lifetime") | F.col("expiry").isNull() | (F.col("expiry") > F.lit("1996-01-01").cast("timestamp_ntz")))
    return ent.groupBy("tier").agg(F.count_if(active).alias("active"), F.count(F.lit(1)).alias("n"))


_ALL = (funnel_stats, funnel_by_plan, perf_route_stats, perf_overall, perf_recent, quota_daily, quota_tiers, quota_team_pool, rate_limit, sync_latest, sync_status, audit_chain, audit_verify, audit_cef)
_ALL += (collab_retention, collab_replay, collab_log, dlq, dlq_page, chat_sessions, chat_history_window, doc_page, doc_with_fields, dashboard_counts, content_cache_stats, active_entitlements)
QUERIES = {f.__name__: f for f in _ALL} | {name: _library_query(name) for name in LIBRARY_QUERIES}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_FUNNEL = f"f AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, CASE event_type WHEN 'view' THEN 'exposure' WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'trial_start' END AS event_type, 'plan' || ({_K} % 3) AS plan FROM events WHERE event_type IN ('view', 'purchase', 'signup'))"
_PERF = "p AS (SELECT event_id AS seq, event_type AS route, value AS p95, event_type = 'error' AS slow FROM events)"
_KEPT = "k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY route ORDER BY seq DESC) <= 100)"
_CALLS = "c AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS identity, CAST(ts AS DATE) AS day, ts FROM events)"
_SYNC = f"s AS (SELECT event_id AS id, ts, user_id AS owner, {_K} % 7 AS file, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'push' END AS op, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS device, value AS size FROM events), l AS (SELECT owner, file, count(*) FILTER (op = 'push') AS version, arg_max(op, (ts, id)) = 'delete' AS deleted, arg_max(device, (ts, id)) FILTER (op = 'push' AND device <> '') AS device, max(ts) AS updated_at, arg_max(size, (ts, id)) AS size FROM s GROUP BY ALL)"
_AUDIT = "a AS (SELECT event_id AS id, ts, user_id % 5 AS team, user_id AS actor, event_type AS action, 'doc=|' || (event_id % 11) AS target, props AS detail FROM events)"
_ESC = "replace(replace(replace({}, '\\', '\\\\'), '|', '\\|'), '=', '\\=')"
_LIB = """i AS (SELECT doc_id, 'Doc ' || doc_id || '.pdf' AS name, source AS folder, lang AS kind, [lang, 'Tag' || (doc_id % 5)] AS tags, coalesce(quality = 0, false) AS favorite, coalesce(toxic = 1, false) AS pinned,
 doc_id * 7919 % 1000 AS modified, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN doc_id * 31 % 500 END AS opened, doc_id % 400 AS created FROM documents LEFT JOIN labels USING (doc_id))"""


def _lib(where: str, key: str) -> str:
    return f"WITH {_LIB} SELECT doc_id, name, pinned FROM i WHERE {where} ORDER BY pinned DESC, {key}, name"


ORACLE_SQL = {
    "funnel_stats": f"WITH {_FUNNEL}, n AS (SELECT v AS variant, count(variant) FILTER (event_type = 'exposure') AS exposure, count(variant) FILTER (event_type = 'conversion') AS conversions_total, count(variant) FILTER (event_type = 'trial_start') AS trials FROM (VALUES ('A'), ('B')) AS t(v) LEFT JOIN f ON v = variant GROUP BY v) SELECT *, CASE WHEN exposure > 0 THEN round(conversions_total / exposure * 100, 2) ELSE 0.0 END AS cvr, CASE WHEN exposure > 0 THEN round(trials / exposure * 100, 2) ELSE 0.0 END AS trial_cvr FROM n",
    "funnel_by_plan": f"WITH {_FUNNEL} SELECT variant, plan, count(*) AS conversions FROM f WHERE event_type = 'conversion' GROUP BY ALL",
    "perf_route_stats": f"WITH {_PERF}, {_KEPT} SELECT route, count(*) AS n, round(avg(p95), 2) AS avg_p95, max(p95) AS max_p95, round(avg(CAST(slow AS INTEGER)) * 100, 2) AS slow_rate, max(seq) AS last_seq FROM k GROUP BY route",
    "perf_overall": f"WITH {_PERF}, {_KEPT} SELECT round(avg(p95), 2) AS overall_avg_p95, count(*) AS total_events, (SELECT count(*) FILTER (slow) FROM (SELECT * FROM p ORDER BY seq DESC LIMIT 1000)) AS recent_slow_frames FROM k",
    "perf_recent": f"WITH {_PERF} SELECT * FROM p ORDER BY seq DESC LIMIT 50",
    "quota_daily": f"WITH {_CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY identity, day ORDER BY ts, id) AS nth FROM c) SELECT id, identity, nth, nth <= {FREE_LIMIT} AS allowed, least(nth, {FREE_LIMIT}) AS used, greatest(0, {FREE_LIMIT} - nth) AS remaining FROM n",
    "quota_tiers": f"WITH {_CALLS}, n AS (SELECT *, (['free', 'basic', 'monthly', 'lifetime'])[CAST(identity AS INTEGER) % 4 + 1] AS tier, row_number() OVER (PARTITION BY identity, day ORDER BY ts, id) AS nth FROM c) SELECT tier, count(*) AS calls, count(*) FILTER (CASE tier WHEN 'free' THEN nth <= {FREE_LIMIT} WHEN 'basic' THEN nth <= {BASIC_LIMIT} ELSE true END) AS allowed FROM n GROUP BY tier",
    "quota_team_pool": f"WITH {_CALLS}, n AS (SELECT CAST(identity AS BIGINT) % 5 AS team, row_number() OVER (PARTITION BY CAST(identity AS BIGINT) % 5, day ORDER BY ts, id) AS nth FROM c) SELECT 'team:' || team AS identity, count(*) FILTER (nth <= least((team + 1) * 40, {TEAM_LIMIT_MAX})) AS allowed, count(*) FILTER (nth > least((team + 1) * 40, {TEAM_LIMIT_MAX})) AS refused FROM n GROUP BY team",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS identity, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT id, identity, n, s AS opened, 1 AS used, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT e.id, e.identity, e.n, CASE WHEN e.s - opened >= 21600 THEN e.s ELSE opened END, CASE WHEN e.s - opened >= 21600 THEN 1 WHEN used < 3 THEN used + 1 ELSE used END, e.s - opened >= 21600 OR used < 3 FROM w JOIN e ON e.identity = w.identity AND e.n = w.n + 1)
 SELECT id, identity, allowed FROM w""",
    "sync_latest": f"WITH {_SYNC} SELECT owner, file, version, device, updated_at, size FROM l WHERE NOT deleted",
    "sync_status": f"WITH {_SYNC} SELECT owner, count(*) AS files, round(sum(size), 4) AS total_size FROM l WHERE NOT deleted GROUP BY owner",
    "audit_chain": f"WITH RECURSIVE r AS (SELECT user_id AS team, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type || '|' || 'doc=|' || (event_id % 11) || '|' || props || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS payload FROM events), c AS (SELECT team, id, r, '{ZEROS}' AS prev_hash, sha256('{ZEROS}|' || payload) AS hash FROM r WHERE r = 1 UNION ALL SELECT r.team, r.id, r.r, c.hash, sha256(c.hash || '|' || payload) FROM c JOIN r ON r.team = c.team AND r.r = c.r + 1) SELECT team, id, prev_hash, hash FROM c",
    "audit_verify": f"WITH {_AUDIT}, h AS (SELECT *, sha256(id || '|' || action) AS hash FROM a), p AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY team ORDER BY ts, id), '{ZEROS}') AS expected FROM h) SELECT team, count(*) AS tampered, min(id) AS first_id FROM p WHERE CASE WHEN id % 10 = 9 THEN 'bad' ELSE expected END <> expected GROUP BY team",
    "audit_cef": f"WITH {_AUDIT} SELECT id, 'CEF:0|paperloom|audit|1.0|' || {_ESC.format('action')} || '|' || {_ESC.format('action')} || '|5|src=' || actor || ' dst=' || team || ' act=' || {_ESC.format('action')} || ' target=' || {_ESC.format('target')} || ' msg=' || {_ESC.format('detail')} AS line FROM a",
    "collab_retention": f"WITH {_AUDIT}, r AS (SELECT *, id % 2 AS file FROM a QUALIFY row_number() OVER (PARTITION BY team, id % 2 ORDER BY ts DESC, id DESC) <= 1000) SELECT team, file, count(*) AS kept, min(id) AS oldest_id FROM r GROUP BY ALL",
    "collab_replay": f"WITH {_AUDIT} SELECT team, row_number() OVER (PARTITION BY team ORDER BY ts, id) AS place, id, action FROM a QUALIFY place <= 100",
    "collab_log": f"WITH {_AUDIT}, k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY team ORDER BY ts DESC, id DESC) <= 20) SELECT team, id, row_number() OVER (PARTITION BY team ORDER BY ts, id) AS place FROM k",
    "dlq": "WITH t AS (SELECT event_id AS attempt_id, ts, user_id * 3 AS hook_id, event_type, 500 + event_id % 4 AS status, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE '' END AS error FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100), h AS (SELECT s_suppkey AS hook_id, 'https://example.com/' || s_name AS url, s_suppkey % 3 <> 0 AS active FROM supplier), f AS (SELECT hook_id, url, active, left('delivery_failed: ' || event_type || ' status=' || status || ' error=' || error, 500) AS reason, attempt_id FROM t JOIN h USING (hook_id)) SELECT * FROM f UNION ALL SELECT hook_id, url, active, 'inactive_or_delivery_failed', NULL FROM (SELECT * FROM h WHERE NOT active ORDER BY hook_id DESC LIMIT 20) WHERE hook_id NOT IN (SELECT hook_id FROM f)",
    "chat_sessions": "SELECT conv_id, count(turn) AS n_messages, coalesce(max(turn), 0) + 1 AS next_seq FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT -1, NULL) GROUP BY conv_id",
    "chat_history_window": "WITH k AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, text FROM k",
    "doc_page": "SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40",
    "doc_with_fields": "SELECT doc_id, source, CASE WHEN quality IS NULL THEN '' ELSE 'quality=' || quality || ';toxic=' || toxic END AS fields FROM documents LEFT JOIN labels USING (doc_id)",
    "dashboard_counts": "SELECT * FROM (SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events), (SELECT count(*) AS documents, count(*) FILTER (n_chars > 12000) AS long_documents FROM documents), (SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations)",
    "content_cache_stats": "WITH n AS (SELECT count(DISTINCT sha256(text)) AS misses, count(*) - count(DISTINCT sha256(text)) AS hits FROM documents) SELECT *, round(hits / (hits + misses) * 100, 1) AS hit_rate FROM n",
    "active_entitlements": "WITH e AS (SELECT o_orderstatus <> 'P' AS valid, (['free', 'basic', 'monthly', 'lifetime'])[o_orderkey % 4 + 1] AS tier, CASE WHEN o_custkey % 5 > 0 THEN o_orderdate END AS expiry FROM orders) SELECT tier, count(*) FILTER (valid AND tier <> 'free' AND (tier = 'lifetime' OR expiry IS NULL OR expiry > TIMESTAMP '1996-01-01')) AS active, count(*) AS n FROM e GROUP BY tier",
    "library_default": _lib("true", "modified DESC"),
    "library_size_asc": _lib("kind = 'en'", "size"),
    "library_tag": _lib("list_has_any(tags, ['Tag1', 'Tag3'])", "lower(name)"),
    "library_search": _lib("contains(lower(name), 'tag2') OR len(list_filter(tags, lambda t: contains(lower(t), 'tag2'))) > 0", "coalesce(opened, created) DESC"),
    "library_favorites": _lib("favorite AND folder = 'src0'", "modified DESC"),
}
ORACLE_SQL["dlq_page"] = f"WITH a AS ({ORACLE_SQL['dlq']}) SELECT *, (SELECT count(*) FROM a) AS dlq_count FROM a ORDER BY attempt_id IS NULL, attempt_id DESC, hook_id DESC LIMIT 100"
