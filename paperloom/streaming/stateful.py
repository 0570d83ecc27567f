"""Streams with state of several kinds, timers and expiry: latency rings, webhook retries, a collaboration relay, a TTL cache.

All run on ``transformWithState``: lists and maps per key in the state store, timers by event time. The watermark
says when a timer is due and when state may go; choose it wide enough that no row comes later. Rows that do
come later are dropped by Spark before they reach an operator, and ``run_to_end`` fails if there are any, so
that none is lost unseen. A batch's rows of one key are taken in order of time and id, and are held by one task:
bound them by the source's files or bytes per trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.operators.usage import ORACLE_SQL as _BATCH_SQL
from paperloom.sources.scratch import scratch_path
from paperloom.streaming.counters import event_stream

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession):
    """State of several columns needs this store; a stream takes the setting as it stands when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def run_to_end(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Runs all there is now into ``path``, a folder a batch; run again with the same folders it goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    with rocks_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if late:
        raise ValueError(f"{late} rows came after the watermark; widen it")


def results(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that batches wrote, with the batch's number."""
    return spark.read.schema(schema.add("batch", "long")).parquet(path)


# Latency rings


RINGS = "route string, salt long, first_seq long, ring array<struct<seq:long,p95:double,slow:boolean>>"


class _Rings(StatefulProcessor):
    """The last ``size`` events of a route's share, and the first event's number."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq long, p95 double, slow boolean")
        self.first = handle.getValueState("first", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = pd.DataFrame(list(self.ring.get()), columns=["seq", "p95", "slow"])
        first = self.first.get()[0] if self.first.exists() else None
        for frame in rows:
            least = int(frame["seq"].min())
            first = least if first is None else min(first, least)
            kept = pd.concat([x for x in (kept, frame[["seq", "p95", "slow"]]) if len(x)]).nlargest(self.size, "seq")
        own = [(int(s), None if pd.isna(p) else float(p), bool(w)) for s, p, w in kept.itertuples(index=False)]
        self.ring.put(own)
        self.first.update((first,))
        yield pd.DataFrame({"route": [key[0]], "salt": [key[1]], "first_seq": [first], "ring": [[{"seq": s, "p95": p, "slow": w} for s, p, w in own]]})

    def close(self) -> None:
        pass


def ring_stream(events: DataFrame, per_route: int = 100, salts: int = 16) -> DataFrame:
    """RINGS in update mode, from events (seq, route, p95, slow). A route is dealt into ``salts`` shares, so a hot one is kept by many tasks."""
    shares = events.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)))
    return shares.groupBy("route", "salt").transformWithStateInPandas(_Rings(per_route), RINGS, "update", "none")


def ring_rollup(updates: DataFrame, per_route: int = 100, max_routes: int = 200) -> DataFrame:
    """Per route what ``usage.route_rollup`` gives, from the updates (RINGS and batch) that a stream wrote."""
    shares = updates.groupBy("route", "salt").agg(F.max_by(F.struct("first_seq", "ring"), "batch").alias("x")).select("route", "salt", "x.*")
    named = shares.groupBy("route").agg(F.min("first_seq").alias("first")).orderBy("first").limit(max_routes).select("route", F.lit(True).alias("named"))
    rows = shares.join(F.broadcast(named), "route", "left").select(F.when(F.col("named"), F.col("route")).otherwise("(other)").alias("route"), F.explode("ring").alias("e"))
    last = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("e.seq")))
    rows = rows.select("route", "e.*", last.alias("r")).where(F.col("r") <= per_route)
    return rows.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("p95"), 2).alias("avg_p95"),
        F.max("p95").alias("max_p95"),
        F.round(F.avg(F.col("slow").cast("double")) * 100, 2).alias("slow_rate"),
        F.max("seq").alias("last_seq"),
    )


# Webhook retries


ATTEMPTS = "event_id long, hook_id long, attempt int, at_ms long, status int, success boolean, final boolean"


class _Retries(StatefulProcessor):
    """First attempts as events come, later ones by timer, until one succeeds, cannot be retried or is the last.

    A key is a share of the hooks. What waits is one list, with one timer for the earliest of it, so a batch costs a share a
    few calls to the store, however many deliveries it has.
    """

    def __init__(self, send: Callable[[int, int, int], int], tries: int, base_ms: int):
        self.send, self.tries, self.base_ms = send, tries, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getListState("due", "at_ms long, event_id long, hook_id long, attempt int")

    def _attempts(self, hook: int, event: int, attempt: int, at_ms: int, now_ms: int, waiting: list[tuple]) -> Iterator[tuple]:
        """This attempt and all later ones that the watermark has passed already; the next one waits."""
        while True:
            status = self.send(hook, event, attempt)
            again = (status >= 500 or status == 429) and attempt < self.tries
            yield event, hook, attempt, at_ms, status, 200 <= status < 300, not again
            if not again:
                return
            at_ms, attempt = at_ms + self.base_ms * 2 ** (attempt - 1), attempt + 1
            if at_ms >= now_ms:
                waiting.append((at_ms, event, hook, attempt))
                return

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, waiting = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            given = zip(frame["hook_id"].tolist(), frame["event_id"].tolist(), frame["at_ms"].tolist())
            yield self._frame([a for h, e, t in given for a in self._attempts(h, e, 1, t, now, waiting)])
        if waiting:
            self.due.appendList(waiting)
            self.handle.registerTimer(min(w[0] for w in waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, waiting, ready = timerValues.getCurrentWatermarkInMs(), [], []
        for at_ms, event, hook, attempt in self.due.get():
            (ready if at_ms < now else waiting).append((at_ms, event, hook, attempt))
        made = [a for at_ms, event, hook, attempt in sorted(ready) for a in self._attempts(hook, event, attempt, at_ms, now, waiting)]
        if made:  # else an earlier timer of this batch did it all
            if waiting:
                self.due.put(waiting)
                self.handle.registerTimer(min(w[0] for w in waiting))
            else:
                self.due.clear()
        yield self._frame(made)

    def close(self) -> None:
        pass


def retry_stream(deliveries: DataFrame, send: Callable[[int, int, int], int], tries: int = 3, base_ms: int = 1000, watermark: str = "0 seconds", shares: int = 1024) -> DataFrame:
    """ATTEMPTS of deliveries (event_id, hook_id, ts), in append mode.

    ``send(hook_id, event_id, attempt)`` returns an HTTP status; 5xx and 429 are tried again after base, 2 x base,
    and so on, up to ``tries`` attempts in all. A retry is made when the watermark has passed its time. What is
    waiting stands in the state, one entry a delivery, and goes with its last attempt. Deliveries are dealt by event into
    ``shares``, so that a hot hook is many tasks' work; a stream goes on with the number that it began with.
    """
    timed = deliveries.withColumn("at_ms", F.unix_millis("ts")).withColumn("share", F.pmod(F.xxhash64("event_id"), F.lit(shares))).withWatermark("ts", watermark)
    return timed.groupBy("share").transformWithStateInPandas(_Retries(send, tries, base_ms), ATTEMPTS, "append", "EventTime")


def dead_letter_rows(attempts: DataFrame) -> DataFrame:
    """Deliveries whose last attempt failed: what a replay starts from."""
    return attempts.where("final AND NOT success").select("event_id", "hook_id", F.col("attempt").alias("attempts"), "status")


# Collaboration relay


RELAYED = "to_user long, command_id long, kind string, at_id long"


class _Relay(StatefulProcessor):
    """A team's connected users and its log of the last ``keep`` commands."""

    def __init__(self, keep: int, replay: int):
        self.keep, self.replay = keep, replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "user long", "since long")
        self.log = handle.getListState("log", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        here = {int(k[0]): int(v[0]) for k, v in self.users.iterator()}
        log = [int(x[0]) for x in self.log.get()]
        before, out = dict(here), []
        for user, event, kind in _ordered(rows, ["at_us", "event_id"])[["user_id", "event_id", "kind"]].itertuples(index=False):
            if kind == "join":
                here[user] = event
                out += [(user, c, "replay", event) for c in log[: self.replay]]
            elif kind == "leave":
                here.pop(user, None)
            elif user in here:
                out += [(u, event, "relay", event) for u in here if u != user]
                log.append(event)
                del log[: max(0, len(log) - self.keep)]
        for user in before.keys() - here.keys():
            self.users.removeKey((user,))
        for user, since in here.items():
            if before.get(user) != since:
                self.users.updateValue((user,), (int(since),))
        self.log.put([(int(x),) for x in log])
        yield pd.DataFrame(out, columns=["to_user", "command_id", "kind", "at_id"])

    def close(self) -> None:
        pass


def relay_stream(events: DataFrame, keep: int = 1000, replay: int = 100) -> DataFrame:
    """RELAYED in append mode, from events (team, user_id, event_id, at_us, kind: join, leave or command).

    A command of a connected user goes to the other connected users of the team and into the log, which keeps the last
    ``keep``. Who joins gets the oldest ``replay`` of the log. Commands of users who are not connected are left out.
    """
    return events.groupBy("team").transformWithStateInPandas(_Relay(keep, replay), RELAYED, "append", "none")


# TTL cache


class _Expiring(StatefulProcessor):
    """When a hash was set; gone when its time is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = int(self.since.get()[0]) if self.since.exists() else None
        frame, hits = _ordered(rows, ["at_us", "id"]), []
        for at in frame["at_us"]:
            hit = since is not None and at - since <= self.ttl_ms * 1000
            if not hit:
                since = int(at)
            hits.append(hit)
        self.since.update((since,))
        self.handle.registerTimer(since // 1000 + self.ttl_ms + 1)
        yield pd.DataFrame({"id": frame["id"], "hash": key[0], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A hash set anew has a later timer of its own.
        if self.since.exists() and int(self.since.get()[0]) // 1000 + self.ttl_ms < expiredTimerInfo.getExpiryTimeInMs():
            self.since.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "hash": pd.Series(dtype="str"), "hit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def expiring_cache_stream(lookups: DataFrame, ttl_seconds: int, watermark: str = "1 day") -> DataFrame:
    """(id, hash, hit) of lookups (id, hash, ts), as ``counters.cache_stream`` gives them, but a hash's state goes once the watermark has passed its time."""
    timed = lookups.withColumn("at_us", F.unix_micros("ts")).withWatermark("ts", watermark)
    return timed.groupBy("hash").transformWithStateInPandas(_Expiring(ttl_seconds * 1000), "id long, hash string, hit boolean", "append", "EventTime")


# Retrieval sessions


STORED = "event_id long, n_sessions long, n_docs long, refused boolean, evicted long"


class _Sessions(StatefulProcessor):
    """A user's sessions, the oldest first, each with its documents."""

    def __init__(self, max_sessions: int, max_docs: int):
        self.max_sessions, self.max_docs = max_sessions, max_docs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "session long, docs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {int(s): list(d) for s, d in self.held.get()}
        out = []
        for session, doc, event in _ordered(rows, ["at_us", "event_id"])[["session", "doc", "event_id"]].itertuples(index=False):
            evicted = None
            if session not in held and len(held) >= self.max_sessions:
                evicted = next(iter(held))
                del held[evicted]
            docs = held.setdefault(session, [])
            refused = doc not in docs and len(docs) >= self.max_docs
            if doc not in docs and not refused:
                docs.append(int(doc))
            out.append((event, len(held), len(docs), refused, evicted))
        self.held.put([(s, d) for s, d in held.items()])
        frame = pd.DataFrame(out, columns=["event_id", "n_sessions", "n_docs", "refused", "evicted"])
        yield frame.assign(evicted=frame["evicted"].astype("Int64"))

    def close(self) -> None:
        pass


def session_stream(requests: DataFrame, max_sessions: int = 100, max_docs: int = 20) -> DataFrame:
    """STORED of indexing requests (user_id, session, doc, event_id, at_us), in append mode: a user's store of sessions, first in, first out.

    A new session beyond ``max_sessions`` puts out the user's oldest; a session takes ``max_docs`` documents and refuses
    more. The store is the user's own, not the server's: a common one would be one after another for all users.
    """
    return requests.groupBy("user_id").transformWithStateInPandas(_Sessions(max_sessions, max_docs), STORED, "append", "none")


# Queries


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    run_to_end(stream, mode, path, scratch_path(spark, f"{name}-checkpoint"))
    return results(spark, path, stream.schema)


def stream_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``perf_route_stats`` gives, from rings kept by a stream."""
    events = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("event_type").alias("route"), F.col("value").alias("p95"), (F.col("event_type") == "error").alias("slow"))
    return ring_rollup(_to_end(ring_stream(events), "rings", "update"))


def _status(hook: int, event: int, attempt: int) -> int:
    kind = (event * 7 + attempt * 3) % 10
    return 503 if kind < 3 else 429 if kind == 3 else 404 if kind == 4 else 200


def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event goes to its user's webhook; the status follows from event and attempt."""
    deliveries = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("hook_id"), "ts")
    return _to_end(retry_stream(deliveries, _status), "retries").drop("batch")


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter_rows(stream_retries(spark, sf_dir))


def stream_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty users a team; signups join, errors leave, all else are commands."""
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").otherwise("command")
    events = _events(spark, sf_dir).select(F.floor(F.col("user_id") / 20).alias("team"), "user_id", "event_id", F.unix_micros("ts").alias("at_us"), kind.alias("kind"))
    return _to_end(relay_stream(events), "relay").drop("batch")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as indexing requests: four sessions a user of three documents each are kept."""
    k = F.get_json_object("props", "$.k").cast("long")
    requests = _events(spark, sf_dir).select("user_id", (k % 7).alias("session"), F.floor(k / 7).alias("doc"), "event_id", F.unix_micros("ts").alias("at_us"))
    return _to_end(session_stream(requests.where("session IS NOT NULL"), 4, 3), "sessions").drop("batch")


def stream_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by the props' content, kept for seven days, counted by hash."""
    lookups = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.sha2("props", 256).alias("hash"), "ts")
    found = _to_end(expiring_cache_stream(lookups, 7 * 86400), "ttl-cache")
    return found.groupBy("hash").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


QUERIES = {f.__name__: f for f in (stream_rings, stream_retries, stream_dead_letters, stream_relay, stream_sessions, stream_ttl_cache)}
_ATTEMPTS_SQL = """WITH RECURSIVE kinds AS (SELECT event_id, user_id AS hook_id, epoch_us(ts) // 1000 AS ms, a, (event_id * 7 + a * 3) % 10 AS k FROM events, range(1, 4) AS t(a)),
 s AS (SELECT *, CASE WHEN k < 3 THEN 503 WHEN k = 3 THEN 429 WHEN k = 4 THEN 404 ELSE 200 END AS status FROM kinds),
 made AS (SELECT *, ms + 1000 * (CAST(pow(2, a - 1) AS BIGINT) - 1) AS at_ms, coalesce(bool_and(status > 404) OVER (PARTITION BY event_id, hook_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS asked FROM s),
 attempts AS (SELECT event_id, hook_id, CAST(a AS INTEGER) AS attempt, at_ms, CAST(status AS INTEGER) AS status, status = 200 AS success, status <= 404 OR a = 3 AS final FROM made WHERE asked AND (a = 1 OR at_ms < (SELECT max(epoch_us(ts)) // 1000 FROM events)))"""
ORACLE_SQL = {
    "stream_rings": _BATCH_SQL["perf_route_stats"],
    "stream_retries": f"{_ATTEMPTS_SQL} SELECT * FROM attempts",
    "stream_dead_letters": f"{_ATTEMPTS_SQL} SELECT event_id, hook_id, attempt AS attempts, status FROM attempts WHERE final AND NOT success",
    "stream_relay": """WITH e AS (SELECT event_id AS id, user_id AS u, user_id // 20 AS team, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'command' END AS kind, row_number() OVER (ORDER BY ts, event_id) AS o FROM events),
 s AS (SELECT u AS who, o AS since, kind AS state FROM e WHERE kind <> 'command'),
 cmd AS (SELECT id, u, team, o, row_number() OVER (PARTITION BY team ORDER BY o) AS n FROM (SELECT e.*, state FROM e ASOF JOIN s ON who = u AND since < o WHERE kind = 'command') WHERE state = 'join'),
 told AS (SELECT m.u AS to_user, c.id, c.o FROM (SELECT DISTINCT team, u FROM e) m JOIN cmd c ON m.team = c.team AND m.u <> c.u),
 relay AS (SELECT to_user, id AS command_id, 'relay' AS kind, id AS at_id FROM (SELECT told.*, state FROM told ASOF JOIN s ON who = to_user AND since < o) WHERE state = 'join'),
 joins AS (SELECT j.id, j.u, j.team, coalesce(c.n, 0) AS k FROM (SELECT * FROM e WHERE kind = 'join') j ASOF LEFT JOIN cmd c ON c.team = j.team AND c.o < j.o)
 SELECT * FROM relay UNION ALL SELECT j.u, c.id, 'replay', j.id FROM joins j JOIN cmd c ON c.team = j.team AND c.n <= k AND c.n > greatest(k - 1000, 0) AND c.n <= greatest(k - 1000, 0) + 100""",
    "stream_ttl_cache": """WITH RECURSIVE l AS (SELECT sha256(props) AS hash, epoch_us(ts) AS t, row_number() OVER (PARTITION BY props ORDER BY ts, event_id) AS n FROM events WHERE props IS NOT NULL),
 walk(hash, n, since, hit) AS (SELECT hash, n, t, false FROM l WHERE n = 1 UNION ALL
 SELECT l.hash, l.n, CASE WHEN t - since <= 604800000000 THEN since ELSE t END, t - since <= 604800000000 FROM walk JOIN l ON l.hash = walk.hash AND l.n = walk.n + 1)
 SELECT hash, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM walk GROUP BY hash""",
}
