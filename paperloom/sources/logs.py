"""Logs and exports: JSON-lines revisions, catalogs with damaged entries, base64 envelopes, CSV and CEF export, HMAC and document ids."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, values_and
from paperloom.operators.usage import ORACLE_SQL as _USAGE_SQL
from paperloom.operators.usage import audit_source, cef_lines
from paperloom.sources.tables import read

REVISION = "id string, at long, summary string"


def revision_log(spark: SparkSession, path: str) -> DataFrame:
    """Good lines of a JSON-lines log, newest first; damaged lines are left out."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    good = lines.select("place", F.from_json("value", REVISION).alias("r")).where("r.id IS NOT NULL")
    return good.orderBy(F.desc("place")).select("r.*")


def catalog_entries(catalog: Column) -> Column:
    """Array of the entries of a JSON array that have an id and a name; the others are salvaged out."""
    raw = F.coalesce(F.from_json(catalog, "array<string>"), F.array().cast("array<string>"))
    entries = F.transform(raw, lambda x: F.from_json(x, "id string, name string, size long"))
    return F.filter(entries, lambda e: e["id"].isNotNull() & e["name"].isNotNull())


def envelope(message: Column, schema: str) -> Column:
    """The record inside ``{"message": {"data": base64 of JSON}}``; null if it cannot be read."""
    data = F.get_json_object(message, "$.message.data")
    return F.from_json(F.try_to_binary(data, F.lit("base64")).cast("string"), schema)


def hmac_sha256(payload: Column, secret: Column) -> Column:
    """Hexadecimal HMAC of a text under a secret of at most 64 bytes, from SHA-256 alone."""
    block = 64
    padded = F.rpad(F.hex(F.encode(secret, "UTF-8")), 2 * block, "0")

    def mixed(byte: int) -> Column:
        pad = F.sequence(F.lit(0), F.lit(block - 1))
        one = F.transform(pad, lambda i: F.lpad(F.hex(F.conv(F.substring(padded, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte).cast("long"))), 2, "0"))
        return F.unhex(F.array_join(one, ""))

    inner = F.sha2(F.concat(mixed(0x36), F.encode(payload, "UTF-8")), 256)
    return F.sha2(F.concat(mixed(0x5C), F.unhex(inner)), 256)


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, in order."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_cef(log: DataFrame, path: str) -> None:
    """One CEF line per entry, in order of time."""
    log.orderBy("ts", "id").select(cef_lines(log).alias("value")).write.mode("overwrite").text(path)


#: An event's catalog, some cut short; in SQL that both engines read.
_CATALOG = """CASE WHEN event_id % 7 = 0 THEN '[{"id": ' ELSE concat('[{"id": "', CAST(event_id AS STRING), '", "name": "', event_type, '", "size": ', CAST(event_id % 50 AS STRING), '}, {"id": "x"}, {"name": "n"}, {"id": "y', CAST(event_id AS STRING), '", "name": "second"}]') END"""
CATALOGS = [(0, '[{"id": "a", "name": "x", "size": 1}, {"id": "b"}, 3, {"id": "c", "name": "y"}]'), (1, "broken"), (2, "[]")]
ENVELOPES = [(0, json.dumps({"message": {"data": base64.b64encode(b'{"token": "t1", "product": "p"}').decode()}})), (1, '{"message": {"data": "%%%"}}'), (2, "{}")]
SIGNED = [(0, "payload", "key"), (1, "", "secret"), (2, "ünïcode", "k" * 64)]


def catalog_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.expr(_CATALOG).alias("catalog"))
    rows = frame(spark, CATALOGS, "id long, catalog string").unionByName(events).select(F.col("id").alias("catalog_id"), F.explode(catalog_entries(F.col("catalog"))).alias("e"))
    return rows.select("catalog_id", "e.*")


def envelope_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit('{"token": "t'), F.col("event_id").cast("string"), F.lit('", "product": "'), "event_type", F.lit('"}'))
    data = F.when(F.col("event_id") % 9 == 0, "%%%").otherwise(F.base64(F.encode(record, "UTF-8")))
    events = read(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.concat(F.lit('{"message": {"data": "'), data, F.lit('"}}')).alias("message"))
    return frame(spark, ENVELOPES, "id long, message string").unionByName(events).select("id", envelope(F.col("message"), "token string, product string").alias("r")).select("id", "r.token", "r.product")


def webhook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.col("props").alias("payload"), F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("secret"))
    rows = frame(spark, SIGNED, "id long, payload string, secret string").unionByName(events)
    return rows.select("id", hmac_sha256(F.col("payload"), F.col("secret")).alias("signature"))


def audit_lines_per_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_source(spark, sf_dir)
    return log.select("team", F.length(cef_lines(log)).alias("n")).groupBy("team").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("chars"))


QUERIES = {f.__name__: f for f in (catalog_salvage, envelope_decode, webhook_signatures, audit_lines_per_team)}
_MORE_ENVELOPES = """SELECT event_id + 1000, '{"message": {"data": "' || CASE WHEN event_id % 9 = 0 THEN '%%%' ELSE to_base64(encode('{"token": "t' || event_id || '", "product": "' || event_type || '"}')) END || '"}}' FROM events"""
ORACLE_SQL = {
    "catalog_salvage": f"SELECT CAST(id AS BIGINT) AS catalog_id, e->>'id' AS id, e->>'name' AS name, CAST(e->>'size' AS BIGINT) AS size FROM (SELECT id, unnest(CAST(j AS JSON[])) AS e FROM (SELECT id, CASE WHEN json_valid(c) THEN CAST(c AS JSON) ELSE '[]' END AS j FROM {values_and(CATALOGS, 'id, c', 't', f'SELECT event_id + 1000, {_CATALOG} FROM events')})) WHERE e->>'id' IS NOT NULL AND e->>'name' IS NOT NULL",
    "envelope_decode": f"SELECT CAST(id AS BIGINT) AS id, d->>'$.token' AS token, d->>'$.product' AS product FROM (SELECT id, CASE WHEN regexp_matches(b, '^[A-Za-z0-9+/=]+$') THEN CAST(decode(from_base64(b)) AS JSON) END AS d FROM (SELECT id, json_extract_string(m, '$.message.data') AS b FROM {values_and(ENVELOPES, 'id, m', 't', _MORE_ENVELOPES)}))",
    "audit_lines_per_team": f"SELECT user_id % 5 AS team, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM ({_USAGE_SQL['audit_cef']}) JOIN events ON event_id = id GROUP BY ALL",
}
