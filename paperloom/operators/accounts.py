"""Who may see and use what: ownership, plugins, entitlements, keys, teams; and small records of files and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import ALLOWED_TYPES, UPLOAD_TYPES, WIDGET_KINDS
from paperloom.sources.tables import read, spread

MAX_UPLOAD = 50 * 1024 * 1024
NOW = 1_704_200_000_000  # milliseconds; the events' second day


def owned(docs: DataFrame, owner: Column) -> DataFrame:
    """An owner's rows; the null owner is a guest, whose rows nobody owns."""
    return docs.where(F.when(owner.isNull(), F.col("owner_id").isNull()).otherwise(F.col("owner_id") == owner))


def plugin_list(plugins: DataFrame, kind: str | None = None, category: str | None = None, entitlement: str | None = None, source: str | None = None, execution: str | None = None, include_disabled: bool = False) -> DataFrame:
    """Plugins that fit, with their place by category and name. ``free`` keeps free ones alone, ``pro`` keeps all."""
    fits = F.lit(True) if include_disabled else F.col("enabled")
    for column, wanted in (("kind", kind), ("category", category), ("source", source), ("execution", execution)):
        if wanted is not None:
            fits &= F.col(column) == wanted
    if entitlement == "free":
        fits &= F.col("entitlement") == "free"
    return plugins.where(fits)


def device_pro(tier: Column, expiry: Column, now: Column) -> Column:
    """Whether a device counts as Pro: any tier but free, until it ends; one whose end is unknown does not lock out who paid."""
    return (tier != "free") & ((tier == "lifetime") | expiry.isNull() | (now < expiry))


def upserted(events: DataFrame) -> DataFrame:
    """(token, product, tier, valid, expiry) after all notifications: the last one's state, with the last product that was named."""
    order = F.struct("ts", "id")
    named = F.max_by(F.nullif("product", F.lit("")), F.when(F.coalesce("product", F.lit("")) != "", order))
    last = F.max_by(F.struct("tier", "valid", "expiry"), order)
    return events.groupBy("token").agg(F.coalesce(named, F.lit("unknown")).alias("product"), last.alias("x")).select("token", "product", "x.*")


def newest(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_r") <= keep).drop("_r")


def backup_due(last: Column, hours: Column, now: Column) -> Column:
    return now - last > hours * 3_600_000


def segments(total: Column, least: int = 2 * 1024 * 1024, most: int = 8) -> Column:
    """How many segments a download is cut into."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(total / least)))


def retry_bounds(attempt: Column, base: int = 500, most: int = 30_000) -> Column:
    """Struct (least, most) of the wait before an attempt: half of the doubled, capped wait, and as much again at random."""
    doubled = base * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20))).cast("long")
    half = F.floor(F.least(doubled, F.lit(most)) / 2)
    return F.struct(half.alias("least"), (2 * half).alias("most"))


def disposition_name(header: Column) -> Column:
    """The file name in a Content-Disposition header, the encoded form first."""
    encoded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*''([^;]+)", 1)
    plain = F.trim(F.regexp_extract(header, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1))
    return F.coalesce(F.when(encoded != "", F.coalesce(F.try_url_decode(F.trim(encoded)), F.trim(encoded))), F.nullif(plain, F.lit("")))


def download_name(header: Column, path: Column, ext: str) -> Column:
    """A download's name: from its header, else its path, else a default; with an extension and no characters that file systems forbid."""
    from_path = F.coalesce(F.try_url_decode(F.substring_index(path, "/", -1)), F.substring_index(path, "/", -1))
    name = F.coalesce(disposition_name(header), F.when(F.trim(from_path) == "", F.lit("download")).otherwise(from_path))
    name = F.when(name.contains("."), name).otherwise(F.concat(name, F.lit("." + ext)))
    clean = F.substring(F.regexp_replace(name, r'[/\\:*?"<>|]', "_"), 1, 120)
    return F.when(F.trim(clean) == "", "download").otherwise(clean)


def upload_errors(mime: Column, size: Column, allowed: tuple[str, ...] = UPLOAD_TYPES) -> Column:
    """Names of the rules that an upload breaks."""
    return F.array_compact(F.array(F.when(~F.coalesce(mime, F.lit("")).isin(*allowed), "type"), F.when(size > MAX_UPLOAD, "size"), F.when(F.coalesce(size, F.lit(0)) == 0, "empty")))


def widget_kind(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WIDGET_KINDS.items() for x in pair])
    return F.coalesce(table[code], F.lit("text"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, text): every page's own text, or else what was read from its image, under a line that names the page; null if no page has any."""
    text = F.coalesce(F.nullif(F.trim(F.coalesce("native", F.lit(""))), F.lit("")), F.trim(F.coalesce("ocr", F.lit(""))))
    block = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), text)
    blocks = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    joined = F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n")
    return pages.withColumn("some", text != "").groupBy("doc_id").agg(F.when(F.bool_or("some"), joined).alias("text"))


def summary_rows(chunks: DataFrame, size: int = 3000) -> DataFrame:
    """A line of JSON for each chunk's summary, in order, and a final one. ``chunks`` has (doc_id, chunk from 0, summary); a document of one chunk has the final one alone."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    rows = chunks.withColumn("total", total.cast("int"))
    span = F.concat_ws("-", (F.col("chunk") * size).cast("string"), ((F.col("chunk") + 1) * size).cast("string"))
    each = F.to_json(F.struct(F.lit("chunk").alias("type"), (F.col("chunk") + 1).alias("index"), "total", "summary", span.alias("chars")))
    parts = rows.where("total > 1").select("doc_id", F.col("chunk").alias("place"), each.alias("line"))
    final = F.to_json(F.struct(F.lit("final").alias("type"), F.first("total").alias("chunks")))
    return parts.unionByName(rows.groupBy("doc_id").agg(F.first("total").alias("place"), final.alias("line")).select("doc_id", "place", "line"))


def match_index(current: Column, total: Column, step: int) -> Column:
    """The next or previous match, around the ends; -1 if there is none. A negative index is none chosen yet."""
    if step > 0:
        return F.when(total <= 0, -1).when(current < 0, 0).otherwise((current + 1) % total)
    return F.when(total <= 0, -1).when(current <= 0, total - 1).otherwise(current - 1)


# Queries over the tables.


def owned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of owner 3 and of guests, counted by source; a source's number names the owner, none is a guest."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7).alias("owner_id"))
    mine = owned(d, F.lit(3)).select("doc_id", F.lit("owner").alias("seen_by"))
    return mine.unionByName(owned(d, F.lit(None)).select("doc_id", F.lit("guest").alias("seen_by")))


def _plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plugins."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), (F.col("p_size") % 5 != 0).alias("enabled"), F.when(F.col("p_size") % 2 == 0, "free").otherwise("pro").alias("entitlement"), F.when(F.col("p_size") % 3 == 0, "builtin").otherwise("remote").alias("source"), F.lit("local").alias("execution"))


def plugins_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free built-in plugins with their place by category and name."""
    found = plugin_list(_plugins(spark, sf_dir), entitlement="free", source="builtin")
    place = F.row_number().over(Window.partitionBy("category").orderBy("name", "id"))
    return found.select("category", place.alias("place"), "name", "id")


def plugin_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugin_list(_plugins(spark, sf_dir), entitlement="pro").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def device_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices."""
    k = F.col("c_custkey")
    tier = F.get(F.array(*map(F.lit, ("free", "trial", "monthly", "lifetime"))), (k % 4).cast("int"))
    expiry = F.when(k % 3 != 0, F.lit(NOW) + (k % 11 - 5) * 1000)
    return read(spark, sf_dir, "customer").select("c_custkey", device_pro(tier, expiry, F.lit(NOW)).alias("pro"), F.when(k % 5 == 0, F.lit(NOW)).isNull().alias("key_active"))


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as memberships of nations' teams; members who are no customers any more are skipped."""
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 25).alias("team"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 100).alias("user_id"), F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("pos"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"))
    return o.join(users, "user_id").select("pos", "team", "user_id", "full_name", "role")


def entitlement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notifications of their user's purchase."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    events = e.select(F.col("user_id").alias("token"), "ts", k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 5).cast("string"))).otherwise("").alias("product"), F.when(F.col("event_type") == "error", "free").otherwise("monthly").alias("tier"), (F.col("event_type") != "error").alias("valid"), F.when(k % 2 == 0, F.lit(NOW) + k).alias("expiry"))
    return upserted(events)


def backups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest backups (orders) of each customer, and whether one is due."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("backup"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"))
    kept = newest(o, "owner", "backup", 10).groupBy("owner").agg(F.count(F.lit(1)).alias("kept"), F.min("backup").alias("oldest"), F.max("at").alias("last"))
    return kept.select("owner", "kept", "oldest", backup_due(F.col("last"), F.lit(24) + F.col("owner") % 100_000, F.lit(1_000_000_000_000)).alias("due"))


def transfer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as downloads, their price as kilobytes."""
    total = F.floor(F.col("o_totalprice") * 100)
    return read(spark, sf_dir, "orders").select("o_orderkey", segments(total).cast("long").alias("segments"), retry_bounds(F.col("o_orderkey") % 12).alias("wait")).select("o_orderkey", "segments", F.col("wait.least").cast("long").alias("wait_least"), F.col("wait.most").cast("long").alias("wait_most"))


def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as downloads: some have a header."""
    k = F.col("page_id")
    header = F.when(k % 4 == 1, F.concat(F.lit("attachment; filename=\"a:"), k.cast("string"), F.lit("\""))).when(k % 4 == 2, F.concat(F.lit("inline; filename*=UTF-8''r%C3%A9sum%C3%A9%20"), k.cast("string"), F.lit(".pdf; filename=x"))).when(k % 8 == 3, F.lit("inline"))
    path = F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), r"^[a-z]+://[^/]*", "")
    return spread(read(spark, sf_dir, "pages")).select("page_id", download_name(header, path, "pdf").alias("name"))


def upload_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, with the kind of a widget of their number."""
    mime = F.get(F.array(*map(F.lit, (*ALLOWED_TYPES, "text/plain"))), (F.col("doc_id") % 10).cast("int"))
    size = F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("n_chars") * 4096)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(upload_errors(mime, size), ",").alias("errors"), mime.isin(*ALLOWED_TYPES).alias("analysable"), widget_kind((F.col("doc_id") % 9).cast("int")).alias("widget"))


def bookmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bookmarks (level, title, page from 1): pages from 0, none before the first."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(0).cast("long"), (F.col("l_quantity") % 7).cast("long") - 1).alias("page"), F.col("l_linenumber").cast("long").alias("level"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a turn is a page, with no text of its own for users."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.when(F.col("role") == "assistant", F.col("text")).alias("native"), F.when(F.col("conv_id") % 3 != 0, F.substring("text", 1, 40)).alias("ocr"))
    return page_blocks(t)


def summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk"), F.md5("text").alias("summary"))
    return summary_rows(t)


def match_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (current, total) of a search."""
    current, total = F.col("o_orderkey") % 9 - 1, F.col("o_custkey") % 6
    return read(spark, sf_dir, "orders").select("o_orderkey", match_index(current, total, 1).cast("long").alias("next"), match_index(current, total, -1).cast("long").alias("previous"))


QUERIES = {f.__name__: f for f in (owned_documents, plugins_listed, plugin_categories, device_entitlements, team_members, entitlement_state, backups_kept, transfer_plans, download_names, upload_screen, bookmark_rows, page_texts, summary_stream, match_steps)}

_MIMES = "[" + ", ".join(f"'{x}'" for x in (*ALLOWED_TYPES, "text/plain")) + "]"
_PLUGIN = "SELECT p_partkey AS id, p_name AS name, p_brand AS category FROM part WHERE p_size % 5 <> 0"
ORACLE_SQL = {
    "owned_documents": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'guest' ELSE 'owner' END AS seen_by FROM documents WHERE doc_id % 4 = 0 OR doc_id % 7 = 3",
    "plugins_listed": f"SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY name, id) AS INTEGER) AS place, name, id FROM ({_PLUGIN} AND p_size % 2 = 0 AND p_size % 3 = 0)",
    "plugin_categories": f"SELECT category, count(*) AS n FROM ({_PLUGIN}) GROUP BY category",
    "device_entitlements": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 3 THEN true ELSE c_custkey % 3 = 0 OR c_custkey % 11 > 5 END AS pro, c_custkey % 5 <> 0 AS key_active FROM customer",
    "team_members": "SELECT o_orderkey AS pos, o_orderkey % 25 AS team, c_custkey AS user_id, c_name AS full_name, o_orderpriority AS role FROM orders JOIN customer ON c_custkey = o_custkey + o_orderkey % 3 * 100",
    "entitlement_state": f"""SELECT user_id AS token, coalesce(arg_max('p' || event_id % 5, struct_pack(ts, event_id)) FILTER (event_id % 3 = 0), 'unknown') AS product, CASE WHEN bool THEN 'monthly' ELSE 'free' END AS tier, bool AS valid, CASE WHEN last % 2 = 0 THEN {NOW} + last END AS expiry
 FROM (SELECT *, last_value(event_type <> 'error') OVER w AS bool, last_value(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY user_id, bool, last""",
    "backups_kept": "SELECT owner, count(*) AS kept, min(backup) AS oldest, 1000000000000 - max(last_at) > (24 + owner % 100000) * 3600000 AS due FROM (SELECT o_custkey AS owner, o_orderkey AS backup, epoch_ms(o_orderdate) AS last_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 10) GROUP BY owner",
    "transfer_plans": "SELECT o_orderkey, greatest(1, least(8, CAST(floor(floor(o_totalprice * 100) / 2097152) AS BIGINT))) AS segments, w // 2 AS wait_least, w // 2 * 2 AS wait_most FROM (SELECT *, least(30000, 500 * CAST(pow(2, greatest(o_orderkey % 12 - 1, 0)) AS BIGINT)) AS w FROM orders)",
    "download_names": r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'a:' || page_id WHEN 2 THEN 'résumé ' || page_id || '.pdf' END AS head, url_decode(string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*', ''), '/')[-1]) AS last FROM pages),
 n AS (SELECT page_id, coalesce(head, CASE WHEN trim(last) = '' THEN 'download' ELSE last END) AS name FROM p)
 SELECT page_id, left(regexp_replace(CASE WHEN contains(name, '.') THEN name ELSE name || '.pdf' END, '[/\\:*?"<>|]', '_', 'g'), 120) AS name FROM n""",
    "upload_screen": f"""SELECT doc_id, concat_ws(',', CASE WHEN {_MIMES}[doc_id % 10 + 1] NOT IN ({', '.join(f"'{x}'" for x in UPLOAD_TYPES)}) THEN 'type' END, CASE WHEN doc_id % 13 <> 0 AND n_chars * 4096 > {MAX_UPLOAD} THEN 'size' END, CASE WHEN doc_id % 13 = 0 OR n_chars = 0 THEN 'empty' END) AS errors,
 doc_id % 10 <> 9 AS analysable, coalesce(['text', 'checkbox', 'radio', 'select', 'text', 'signature'][CASE WHEN doc_id % 9 BETWEEN 1 AND 6 THEN doc_id % 9 END], 'text') AS widget FROM documents""",
    "bookmark_rows": "SELECT l_orderkey, l_linenumber, greatest(0, CAST(l_quantity AS BIGINT) % 7 - 1) AS page, CAST(l_linenumber AS BIGINT) AS level FROM lineitem",
    "page_texts": "SELECT doc_id, CASE WHEN bool_or(t <> '') THEN string_agg('--- Page ' || page || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY page) END AS text FROM (SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN role = 'assistant' AND trim(text) <> '' THEN trim(text) WHEN conv_id % 3 <> 0 THEN trim(left(text, 40)) ELSE '' END AS t FROM conversations) GROUP BY doc_id",
    "summary_stream": """WITH c AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk, md5(text) AS s, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS total FROM conversations)
 SELECT doc_id, chunk AS place, '{"type":"chunk","index":' || chunk + 1 || ',"total":' || total || ',"summary":"' || s || '","chars":"' || chunk * 3000 || '-' || (chunk + 1) * 3000 || '"}' AS line FROM c WHERE total > 1
 UNION ALL SELECT doc_id, any_value(total), '{"type":"final","chunks":' || any_value(total) || '}' FROM c GROUP BY doc_id""",
    "match_steps": "SELECT o_orderkey, CASE WHEN t = 0 THEN -1 ELSE (c + 1) % t END AS next, CASE WHEN t = 0 THEN -1 WHEN c < 1 THEN t - 1 ELSE c - 1 END AS previous FROM (SELECT o_orderkey, o_orderkey % 9 - 1 AS c, o_custkey % 6 AS t FROM orders)",
}
