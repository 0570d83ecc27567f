"""Small record operators: predicates on lists and maps, team joins, retention, colours, options, ages, plane geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, pick, values_and
from paperloom.sources.tables import read

#: Event types that a webhook may name, and keys that never leave an audit record.
EVENT_TYPES = ("view", "purchase", "signup")
SENSITIVE = ("password", "token", "api_key", "secret", "ssn")


def csv_list(x: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def receipt_errors(product: Column, token: Column, products: list[str]) -> Column:
    """Names of the rules that a receipt breaks; empty if none."""
    t = F.coalesce(token, F.lit(""))
    rules = [(F.length(t) < 20, "short"), (F.length(t) > 2000, "long"), (F.coalesce(product, F.lit("")) == "", "no_product"), ((product != "") & ~product.isin(products), "unknown_product"), (t.rlike("[ \n\t<>]"), "characters")]
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))


def without_sensitive(details: Column) -> Column:
    return F.map_filter(details, lambda k, v: ~F.lower(k).isin(*SENSITIVE))


def profile_summary(profile: Column) -> Column:
    """``Title Case Key: value`` lines of the filled keys, in order of key, without ids and partial numbers."""
    kept = F.map_filter(profile, lambda k, v: ~k.isin("id", "user_id", "ssn_last_four") & (F.coalesce(v, F.lit("")) != ""))
    lines = F.transform(F.sort_array(F.map_entries(kept)), lambda e: F.concat_ws(": ", F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), e["value"]))
    return F.array_join(lines, "\n")


def kind_fits(kind: Column, value: Column) -> Column:
    """The lenient check of a loose value by its kind."""
    s = F.trim(value)
    by_kind = (
        F.when(kind == "email", s.contains("@") & s.contains("."))
        .when(kind == "phone", F.length(F.regexp_replace(s, "[^0-9]", "")) >= 7)
        .when(kind == "date", s.rlike("[0-9]"))
        .when(kind == "postalCode", s.rlike("[0-9]{3,}"))
        .when(kind == "iban", F.replace(s, F.lit(" "), F.lit("")).rlike("^[A-Za-z]{2}[0-9]"))
        .when(kind == "name", s.rlike("[A-Za-zÀ-ÿ]"))
        .otherwise(True)
    )
    return (s != "") & (F.length(s) <= 80) & by_kind


def option(category: Column, raw: Column) -> Column:
    """Canonical gender or marital status; female is tried before male, which it contains."""
    s = F.lower(F.trim(raw))
    gender = F.when(s.rlike("weib|female|frau") | s.isin("w", "f"), "female").when(s.contains("divers") | (s == "d"), "diverse").when(s.rlike("männ|mannl|male|herr") | (s == "m"), "male")
    marital = F.when(s.rlike("ledig|single"), "single").when(s.rlike("verheir|married"), "married").when(s.rlike("geschied|divorc"), "divorced").when(s.rlike("verwitw|widow"), "widowed")
    return F.when(category == "gender", gender).otherwise(marital)


def fill_rgb(fill: Column) -> Column:
    """(r, g, b) from 0 to 255 of white, black, #RGB or #RRGGBB; blank and null are black, anything else null."""
    name = F.lower(F.trim(fill))
    digits = F.ltrim(name, F.lit("#"))
    digits = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    parts = [F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    shade = lambda n: F.array(*[F.lit(n)] * 3)
    return F.when(F.coalesce(name, F.lit("")).isin("", "black"), shade(0)).when(name == "white", shade(255)).when(digits.rlike("^[0-9a-f]{6}$"), F.array(*parts))


def age(born: Column, as_of: Column) -> Column:
    """Full years, if from 1 to 149."""
    n = F.floor(F.months_between(F.trunc(as_of, "MM"), F.trunc(born, "MM")) / 12).cast("long")
    early = (F.month(as_of) == F.month(born)) & (F.dayofmonth(as_of) < F.dayofmonth(born))
    years = n - early.cast("long")
    return F.when(years.between(1, 149), years)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def smoothed(points: Column) -> Column:
    """One round of corner cutting over an array of (x, y): ends stay, each inner stretch gives points at a quarter and three quarters."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.array(*[F.struct((a["x"] * p + b["x"] * (1 - p)).alias("x"), (a["y"] * p + b["y"] * (1 - p)).alias("y")) for p in (0.75, 0.25)]))
    return F.when(F.size(points) < 3, points).otherwise(F.concat(F.slice(points, 1, 1), F.flatten(pairs), F.slice(points, -1, 1)))


def document_ids(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds document_id: the 64-bit FNV-1a hash of the path's UTF-8 bytes, 16 hexadecimal digits."""

    @F.pandas_udf("string")
    def fnv(texts: pd.Series) -> pd.Series:
        raw = [t.encode() if t is not None else b"" for t in texts]
        size = np.array([len(b) for b in raw])
        table = np.zeros((len(raw), size.max(initial=0)), np.uint64)
        for i, b in enumerate(raw):
            table[i, : len(b)] = np.frombuffer(b, np.uint8)
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        for k in range(table.shape[1]):  # all paths' k-th bytes at once; the product wraps
            h = np.where(k < size, (h ^ table[:, k]) * np.uint64(0x100000001B3), h)
        return pd.Series([f"{x:016x}" for x in h.tolist()])

    return paths.withColumn("document_id", fnv(F.col(column)))


RECEIPTS = [(1, "monthly", "a" * 20), (2, "", "short"), (3, "gold", "x y" * 10), (4, None, None), (5, "yearly", "b" * 2001), (6, "lifetime", "<" + "c" * 30)]
VALUES = [(1, "email", "a@b.c"), (2, "email", "ab"), (3, "phone", "12 34 567"), (4, "phone", "123"), (5, "date", "March"), (6, "postalCode", "D-10115"), (7, "iban", " DE 89"), (8, "name", "123"), (9, "text", "x"), (10, "text", "y" * 81), (11, "name", "  ")]
OPTIONS = [(1, "gender", "Weiblich"), (2, "gender", "Male"), (3, "gender", "female"), (4, "gender", " M "), (5, "gender", "Kaufmann"), (6, "gender", "divers"), (7, "marital", "verheiratet"), (8, "marital", "Single"), (9, "marital", "x"), (10, "marital", "Divorced"), (11, "gender", "")]
FILLS = [(1, "white"), (2, " Black "), (3, None), (4, "#0f8"), (5, "#102030"), (6, "#12"), (7, "red"), (8, "ABCDEF"), (9, "")]


def webhook_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active webhooks (suppliers) that name an event type in their list, and the unknown names in it."""
    lists = F.concat(F.lit("view, "), F.when(F.col("s_suppkey") % 2 == 0, "purchase,").otherwise(" ,bogus"))
    hooks = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hook_id"), csv_list(lists).alias("events"), (F.col("s_suppkey") % 3 != 0).alias("active"))
    wants = F.col("active") & F.array_contains("events", "purchase")
    return hooks.select("hook_id", wants.alias("gets_purchase"), F.array_join(F.array_except("events", F.array(*map(F.lit, EVENT_TYPES))), ",").alias("unknown"))


def receipt_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    product = F.get(F.array(*map(F.lit, ("monthly", "yearly", "lifetime", "gold", ""))), (k % 5).cast("int"))
    token = F.concat(F.repeat(F.lit("ab"), (k % 1100).cast("int")), F.when(k % 7 == 0, "<").otherwise("z"))
    orders = read(spark, sf_dir, "orders").select((k + 1000).alias("id"), product.alias("product"), token.alias("token"))
    rows = frame(spark, RECEIPTS, "id long, product string, token string").unionByName(orders)
    return rows.select("id", F.array_join(receipt_errors(F.col("product"), F.col("token"), ["monthly", "yearly", "lifetime"]), ",").alias("errors"))


def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    details = F.create_map(F.lit("Token"), F.col("props"), F.lit("action"), F.col("event_type"), F.lit("ssn"), F.lit("1"))
    return e.select("event_id", F.array_join(F.map_keys(without_sensitive(details)), ",").alias("kept"))


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    profile = F.create_map(F.lit("full_name"), F.col("c_name"), F.lit("user_id"), F.col("c_custkey").cast("string"), F.lit("market_segment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", profile_summary(profile).alias("summary"))


def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("email", "phone", "date", "postalCode", "iban", "name", "other"))), (k % 7).cast("int"))
    text = F.get(F.array(F.col("o_orderpriority"), F.concat(F.lit(" user"), k.cast("string"), F.lit("@example.org")), (k * 7919).cast("string"), F.concat(F.lit("DE"), k.cast("string")), F.repeat("o_orderstatus", (k % 100).cast("int"))), (k % 5).cast("int"))
    orders = read(spark, sf_dir, "orders").select((k + 1000).alias("id"), kind.alias("kind"), text.alias("value"))
    return frame(spark, VALUES, "id long, kind string, value string").unionByName(orders).select("id", kind_fits(F.col("kind"), F.col("value")).alias("fits"))


def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    own = lambda c: F.get(F.array(*[F.lit(r[c]) for r in OPTIONS]), (k % len(OPTIONS)).cast("int"))
    customers = read(spark, sf_dir, "customer").select((k + 1000).alias("id"), own(1).alias("category"), F.concat(own(2), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment"))).alias("raw"))
    return frame(spark, OPTIONS, "id long, category string, raw string").unionByName(customers).select("id", option(F.col("category"), F.col("raw")).alias("value"))


def fill_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    six, three = F.lpad(F.hex(k * 7919 % 16777216), 6, "0"), F.lpad(F.hex(k * 31 % 4096), 3, "0")
    parts = read(spark, sf_dir, "part").select((k + 1000).alias("id"), F.when(k % 5 == 0, F.col("p_brand")).when(k % 5 == 1, three).when(k % 5 == 2, F.concat(F.lit(" #"), F.lower(three))).otherwise(F.concat(F.lit("#"), six)).alias("fill"))
    return frame(spark, FILLS, "id long, fill string").unionByName(parts).select("id", F.array_join(F.transform(fill_rgb(F.col("fill")), lambda x: x.cast("string")), ",").alias("rgb"))


def order_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full years on 15 July 2026 since the day twenty years before each order."""
    born = F.add_months(F.to_date("o_orderdate"), -12 * 20)
    return read(spark, sf_dir, "orders").select("o_orderkey", age(born, F.lit("2026-07-15").cast("date")).alias("age"))


def team_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as teams, customers as members: each member's team with its size, owner first."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    sizes = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"), F.min("c_custkey").alias("owner"))
    return n.join(sizes, n["n_nationkey"] == sizes["c_nationkey"]).select("n_name", "members", "owner", F.lit(True).alias("active"))


def unanswered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested documents with their label, or the default where none was returned; labels nobody asked for are dropped."""
    asked = read(spark, sf_dir, "documents").select("doc_id")
    told = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"), F.lit(0.9).alias("confidence"))
    known = told.join(asked, "doc_id", "left_semi")
    missing = asked.join(told, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("value"), F.lit(0.0).alias("confidence"))
    return known.unionByName(missing)


def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event of every kind and k modulo 40, newest first, at most 60."""
    e = read(spark, sf_dir, "events")
    path = F.concat_ws("/", F.col("event_type"), (F.get_json_object("props", "$.k").cast("long") % 40).cast("string"))
    latest = e.groupBy("user_id", path.alias("path")).agg(F.max(F.struct("ts", "event_id")).alias("x"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("x")))
    return latest.withColumn("place", place.cast("long")).where("place <= 60").select("user_id", "place", "path", "x.event_id")


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before the second and third try of failed deliveries: 1 s doubled, for statuses of 500 and more and for 429."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.element_at(F.array(F.lit(429), F.lit(500), F.lit(404), F.lit(503)), (F.col("event_id") % 4 + 1).cast("int")).alias("status"))
    again = (F.col("status") >= 500) | (F.col("status") == 429)
    tries = F.explode(F.when(again, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1))))
    return e.select("event_id", "status", tries.alias("attempt")).withColumn("wait", F.when(F.col("attempt") > 1, F.pow(F.lit(2.0), F.col("attempt") - 2)).otherwise(0.0))


def stroke_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col(c) / 100.0 for c in ("l_quantity", "l_linenumber")]
    a, b = (F.col("l_partkey") % 7) / 7.0, (F.col("l_suppkey") % 5) / 5.0
    d = segment_distance(x[0], x[1], a, b, b, a)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("distance"))


def masked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four digits where there are four, and how much smaller the account became, in percent."""
    c = read(spark, sf_dir, "customer")
    digits = F.regexp_replace("c_name", "[^1-9]", "")
    return c.select("c_custkey", F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).alias("last_four"), F.when(F.col("c_acctbal") != 0, F.round((1 - F.col("c_custkey") / F.col("c_acctbal")) * 100, 4)).otherwise(0.0).alias("reduction"))


def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_ids(read(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "document_id")


def smooth_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over each order's lines as points in order; the number of points and the mean place."""
    p = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))))
    strokes = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(p, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("p"))
    for _ in range(2):
        strokes = strokes.withColumn("p", smoothed(F.col("p")))
    return strokes.select("l_orderkey", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, q: a + q["x"]) / F.size("p"), 6).alias("mean_x"))


_ALL = (webhook_subscribers, receipt_preflight, audit_details, profile_lines, lenient_values, option_values, fill_colours, order_ages, team_overview, unanswered_fields, recent_files, retry_schedule, stroke_distance, masked_numbers, path_ids, smooth_strokes)
QUERIES = {f.__name__: f for f in _ALL}

_D = {"x": "l_quantity / 100", "y": "l_linenumber / 100", "a": "(l_partkey % 7) / 7", "b": "(l_suppkey % 5) / 5"}
_CUT = "CASE WHEN len({0}) < 3 THEN {0} ELSE [{0}[1]] || flatten(list_transform(range(1, len({0})), lambda i: [{0}[i] * 0.75::DOUBLE + {0}[i + 1] * 0.25::DOUBLE, {0}[i] * 0.25::DOUBLE + {0}[i + 1] * 0.75::DOUBLE])) || [{0}[-1]] END"
_MORE_RECEIPTS = "SELECT o_orderkey + 1000, ['monthly', 'yearly', 'lifetime', 'gold', ''][o_orderkey % 5 + 1], repeat('ab', o_orderkey % 1100) || CASE WHEN o_orderkey % 7 = 0 THEN '<' ELSE 'z' END FROM orders"
_MORE_VALUES = "SELECT o_orderkey + 1000, ['email', 'phone', 'date', 'postalCode', 'iban', 'name', 'other'][o_orderkey % 7 + 1], [o_orderpriority, ' user' || o_orderkey || '@example.org', CAST(o_orderkey * 7919 AS VARCHAR), 'DE' || o_orderkey, repeat(o_orderstatus, o_orderkey % 100)][o_orderkey % 5 + 1] FROM orders"
_MORE_OPTIONS = f"SELECT c_custkey + 1000, {pick(OPTIONS, 1, f'c_custkey % {len(OPTIONS)}')}, {pick(OPTIONS, 2, f'c_custkey % {len(OPTIONS)}')} || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || c_mktsegment END FROM customer"
_MORE_FILLS = "SELECT k + 1000, CASE k % 5 WHEN 0 THEN p_brand WHEN 1 THEN three WHEN 2 THEN ' #' || lower(three) ELSE '#' || lpad(to_hex(k * 7919 % 16777216), 6, '0') END FROM (SELECT p_partkey AS k, p_brand, lpad(to_hex(p_partkey * 31 % 4096), 3, '0') AS three FROM part)"
ORACLE_SQL = {
    "smooth_strokes": f"WITH s AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_tax) AS x FROM lineitem GROUP BY l_orderkey), a AS (SELECT l_orderkey, {_CUT.format('x')} AS y FROM s), b AS (SELECT l_orderkey, {_CUT.format('y')} AS z FROM a) SELECT l_orderkey, CAST(len(z) AS BIGINT) AS n, round(list_sum(z) / len(z), 6) AS mean_x FROM b",
    "webhook_subscribers": "SELECT s_suppkey AS hook_id, s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 AS gets_purchase, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'bogus' END AS unknown FROM supplier",
    "receipt_preflight": f"SELECT CAST(id AS BIGINT) AS id, array_to_string(list_filter([CASE WHEN length(t) < 20 THEN 'short' END, CASE WHEN length(t) > 2000 THEN 'long' END, CASE WHEN p = '' THEN 'no_product' END, CASE WHEN p <> '' AND p NOT IN ('monthly', 'yearly', 'lifetime') THEN 'unknown_product' END, CASE WHEN regexp_matches(t, '[ \\n\\t<>]') THEN 'characters' END], lambda e: e IS NOT NULL), ',') AS errors FROM (SELECT id, coalesce(product, '') AS p, coalesce(token, '') AS t FROM {values_and(RECEIPTS, 'id, product, token', 'r', _MORE_RECEIPTS)})",
    "audit_details": "SELECT event_id, 'action' AS kept FROM events",
    "profile_lines": "SELECT c_custkey, 'Full Name: ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'Market Segment: ' || c_mktsegment END AS summary FROM customer",
    "lenient_values": f"SELECT CAST(id AS BIGINT) AS id, s <> '' AND length(s) <= 80 AND CASE kind WHEN 'email' THEN contains(s, '@') AND contains(s, '.') WHEN 'phone' THEN length(regexp_replace(s, '[^0-9]', '', 'g')) >= 7 WHEN 'date' THEN regexp_matches(s, '[0-9]') WHEN 'postalCode' THEN regexp_matches(s, '[0-9]{{3,}}') WHEN 'iban' THEN regexp_matches(replace(s, ' ', ''), '^[A-Za-z]{{2}}[0-9]') WHEN 'name' THEN regexp_matches(s, '[A-Za-zÀ-ÿ]') ELSE true END AS fits FROM (SELECT id, kind, trim(v) AS s FROM {values_and(VALUES, 'id, kind, v', 't', _MORE_VALUES)})",
    "option_values": f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN c = 'gender' THEN CASE WHEN regexp_matches(s, 'weib|female|frau') OR s IN ('w', 'f') THEN 'female' WHEN contains(s, 'divers') OR s = 'd' THEN 'diverse' WHEN regexp_matches(s, 'männ|mannl|male|herr') OR s = 'm' THEN 'male' END ELSE CASE WHEN regexp_matches(s, 'ledig|single') THEN 'single' WHEN regexp_matches(s, 'verheir|married') THEN 'married' WHEN regexp_matches(s, 'geschied|divorc') THEN 'divorced' WHEN regexp_matches(s, 'verwitw|widow') THEN 'widowed' END END AS value FROM (SELECT id, c, lower(trim(raw)) AS s FROM {values_and(OPTIONS, 'id, c, raw', 'o', _MORE_OPTIONS)})",
    "fill_colours": f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN coalesce(n, '') IN ('', 'black') THEN '0,0,0' WHEN n = 'white' THEN '255,255,255' WHEN regexp_matches(h, '^[0-9a-f]{{6}}$') THEN array_to_string(list_transform([h[1:2], h[3:4], h[5:6]], lambda p: CAST('0x' || p AS INTEGER)), ',') END AS rgb FROM (SELECT id, n, CASE WHEN length(d) = 3 THEN regexp_replace(d, '(.)', '\\1\\1', 'g') ELSE d END AS h FROM (SELECT id, n, ltrim(n, '#') AS d FROM (SELECT id, lower(trim(fill)) AS n FROM {values_and(FILLS, 'id, fill', 'f', _MORE_FILLS)})))",
    "order_ages": "SELECT o_orderkey, CASE WHEN a BETWEEN 1 AND 149 THEN a END AS age FROM (SELECT o_orderkey, date_sub('year', CAST(CAST(o_orderdate AS DATE) - INTERVAL 20 YEAR AS DATE), DATE '2026-07-15') AS a FROM orders)",
    "team_overview": "SELECT n_name, count(*) AS members, min(c_custkey) AS owner, true AS active FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey",
    "unanswered_fields": "SELECT doc_id, coalesce(quality, -1) AS value, CASE WHEN quality IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM documents LEFT JOIN labels USING (doc_id)",
    "recent_files": "WITH l AS (SELECT user_id, event_type || '/' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 40) AS path, max((ts, event_id)) AS x, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY x DESC) AS place, path, event_id FROM l QUALIFY place <= 60",
    "retry_schedule": "WITH e AS (SELECT event_id, ([429, 500, 404, 503])[event_id % 4 + 1] AS status FROM events WHERE event_type = 'error') SELECT event_id, status, a AS attempt, CASE WHEN a > 1 THEN pow(2.0::DOUBLE, a - 2) ELSE 0.0::DOUBLE END AS wait FROM e, (VALUES (1), (2), (3)) AS t(a) WHERE a = 1 OR status >= 500 OR status = 429",
    "stroke_distance": f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {_D['x']} AS px, {_D['y']} AS py, {_D['a']} AS a, {_D['b']} AS b FROM lineitem), t AS (SELECT *, CASE WHEN a = b THEN 0.0::DOUBLE ELSE least(greatest(((px - a) * (b - a) + (py - b) * (a - b)) / (2 * (b - a) * (b - a)), 0.0::DOUBLE), 1.0::DOUBLE) END AS t FROM p) SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(pow(px - (a + t * (b - a)), 2) + pow(py - (b + t * (a - b)), 2)), 6) AS distance FROM t",
    "path_ids": "SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::UBIGINT)), lambda a, c: ((xor(a, c)::UHUGEINT * 1099511628211) % 18446744073709551616::UHUGEINT)::UBIGINT))), 16, '0') AS document_id FROM pages",
    "masked_numbers": "SELECT c_custkey, CASE WHEN length(d) >= 4 THEN right(d, 4) END AS last_four, CASE WHEN c_acctbal <> 0 THEN round((1 - c_custkey / c_acctbal) * 100, 4) ELSE 0.0::DOUBLE END AS reduction FROM (SELECT *, regexp_replace(c_name, '[^1-9]', '', 'g') AS d FROM customer)",
}
