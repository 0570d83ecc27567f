import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import usage
from paperloom.streaming import stateful

SCHEMA = "event_id long, ts timestamp, user_id long, kind string, value double"


def rows(n, seed=1, users=6):
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(seconds=i * 0.7 + r.random() * 0.5), r.randrange(users), r.choice(["join", "leave", "command", "command"]), float(r.randrange(50))) for i in range(n)]


def files(spark, tmp_path, given, parts):
    size = -(-len(given) // parts)
    for k in range(parts):
        part = given[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))


def source(spark, tmp_path, upto=99):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def in_two_runs(spark, tmp_path, given, build, mode="append"):
    """All rows of a stream over the first files, stopped, and restarted from its checkpoint over the rest."""
    half = len(given) // 2
    files(spark, tmp_path, given[:half], 3)
    for k in range(2):
        if k:
            part = given[half:]
            for j in range(3):
                size = -(-len(part) // 3)
                spark.createDataFrame(part[j * size : (j + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{10 + j}"))
        stream = build(source(spark, tmp_path))
        stateful.run_to_end(stream, mode, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return stateful.results(spark, str(tmp_path / "out"), stream.schema)


def test_rings_equal_their_batch_twin(spark, tmp_path):
    given = rows(600)
    shape = lambda e: e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("route"), F.col("value").alias("p95"), (F.col("kind") == "leave").alias("slow"))
    updates = in_two_runs(spark, tmp_path, given, lambda s: stateful.ring_stream(shape(s), 20, 4), "update")
    assert updates.selectExpr("max(size(ring))").first()[0] <= 20
    got = sorted(map(tuple, stateful.ring_rollup(updates, 20, 4).collect()))
    want = usage.route_rollup(shape(spark.createDataFrame(given, SCHEMA)), 20, 4)
    assert got == sorted(map(tuple, want.collect())) and "(other)" in {g[0] for g in got}


def retried(given, send, until):
    out = []
    for event, ts, user, _, _ in given:
        at = int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        for attempt in (1, 2, 3):
            if attempt > 1 and at >= until:
                break
            status = send(user, event, attempt)
            again = (status >= 500 or status == 429) and attempt < 3
            out.append((event, user, attempt, at, status, 200 <= status < 300, not again))
            if not again:
                break
            at += 1000 * 2 ** (attempt - 1)
    return sorted(out)


def test_retries_fire_by_timer_and_survive_a_restart(spark, tmp_path):
    given = rows(240)
    send = lambda hook, event, attempt: [200, 503, 429, 404, 500, 503, 200][(event * 3 + attempt * (hook + 1)) % 7]
    got = in_two_runs(spark, tmp_path, given, lambda s: stateful.retry_stream(s.select("event_id", F.col("user_id").alias("hook_id"), "ts"), send))
    until = max(int(g[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) for g in given)
    want = retried(given, send, until)
    assert sorted(map(tuple, got.drop("batch").collect())) == want
    # A batch's retries come in later batches than their first attempts, not all at once.
    assert got.where("attempt > 1").select("batch").distinct().count() > 2
    letters = {(r["event_id"], r["attempts"]) for r in stateful.dead_letter_rows(got).collect()}
    assert letters == {(w[0], w[2]) for w in want if w[6] and not w[5]}


def test_one_list_and_timer_serve_a_share_of_all_hooks(spark, tmp_path):
    given = rows(200, 3, users=50)
    send = lambda hook, event, attempt: 503 if (hook + event + attempt) % 3 else 200
    got = in_two_runs(spark, tmp_path, given, lambda s: stateful.retry_stream(s.select("event_id", F.col("user_id").alias("hook_id"), "ts"), send, shares=2))
    until = max(int(g[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) for g in given)
    assert sorted(map(tuple, got.drop("batch").collect())) == retried(given, send, until)


def relayed(given, keep, replay):
    here, log, out = set(), [], []
    for event, _, user, kind, _ in sorted(given, key=lambda g: (g[1], g[0])):
        if kind == "join":
            here.add(user)
            out += [(user, c, "replay", event) for c in log[:replay]]
        elif kind == "leave":
            here.discard(user)
        elif user in here:
            out += [(u, event, "relay", event) for u in here - {user}]
            log = [*log, event][-keep:]
    return sorted(out)


def test_relay_equals_a_walk_over_all_events(spark, tmp_path):
    given = rows(300, seed=4)
    shape = lambda s: s.select(F.lit(1).alias("team"), "user_id", "event_id", F.unix_micros("ts").alias("at_us"), "kind")
    got = in_two_runs(spark, tmp_path, given, lambda s: stateful.relay_stream(shape(s), 30, 7))
    assert sorted(map(tuple, got.drop("batch").collect())) == relayed(given, 30, 7)


def test_sessions_go_first_in_first_out(spark, tmp_path):
    given = rows(300, seed=9, users=3)
    shape = lambda s: s.select("user_id", (F.col("value") % 6).cast("long").alias("session"), F.floor(F.col("value") / 6).alias("doc"), "event_id", F.unix_micros("ts").alias("at_us"))
    got = in_two_runs(spark, tmp_path, given, lambda s: stateful.session_stream(shape(s), 3, 2))
    want, users = [], {}
    for event, _, user, _, value in sorted(given, key=lambda g: (g[1], g[0])):
        held = users.setdefault(user, {})
        session, doc, evicted = int(value % 6), int(value // 6), None
        if session not in held and len(held) == 3:
            evicted = next(iter(held))
            del held[evicted]
        docs = held.setdefault(session, set())
        refused = doc not in docs and len(docs) == 2
        if not refused:
            docs.add(doc)
        want.append((event, len(held), len(docs), refused, evicted))
    assert sorted(map(tuple, got.drop("batch").collect()), key=str) == sorted(want, key=str)


def test_cache_entries_expire_and_hits_stay_right(spark, tmp_path):
    given = rows(400, users=40)
    build = lambda s: stateful.expiring_cache_stream(s.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("hash"), "ts"), 20, "2 seconds")
    got = {r["id"]: r["hit"] for r in in_two_runs(spark, tmp_path, given, build).collect()}
    since, want = {}, {}
    for event, ts, user, _, _ in sorted(given, key=lambda g: (g[1], g[0])):
        want[event] = user in since and (ts - since[user]).total_seconds() <= 20
        if not want[event]:
            since[user] = ts
    assert got == want and len(set(want.values())) == 2
    state = spark.read.format("statestore").option("stateVarName", "since").load(str(tmp_path / "checkpoint")).where("value IS NOT NULL")
    assert state.count() < 40  # those out of time are gone


def test_late_rows_are_never_lost_unseen(spark, tmp_path):
    given = rows(60)
    files(spark, tmp_path, given[40:] + given[20:40] + given[:20], 3)  # late rows are dropped from the second batch after on
    stream = stateful.retry_stream(source(spark, tmp_path).select("event_id", F.col("user_id").alias("hook_id"), "ts"), lambda *_: 200)
    with pytest.raises(ValueError, match="20 rows"):
        stateful.run_to_end(stream, "append", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
