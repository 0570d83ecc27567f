"""File screening and links: type by magic bytes, content type and address; PDF verdict; links in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, values, values_and
from paperloom.sources.tables import read

#: Leading bytes, in order, with MIME type and extension. A dot is any byte.
MAGIC = [
    ("25504446", "application/pdf", "pdf"), ("89504E47", "image/png", "png"), ("FFD8FF", "image/jpeg", "jpg"), ("47494638", "image/gif", "gif"),
    ("424D", "image/bmp", "bmp"), ("52494646........57454250", "image/webp", "webp"), ("........66747970", "video/mp4", "mp4"), ("494433", "audio/mpeg", "mp3"),
    ("FFFB", "audio/mpeg", "mp3"), ("4F676753", "audio/ogg", "ogg"), ("1F8B", "application/gzip", "gz"), ("504B0304", "application/zip", "zip"),
    ("52617221", "application/vnd.rar", "rar"), ("7B5C7274", "application/rtf", "rtf"),
]
#: MIME type by extension; the first extension of a type is its own.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "zip": "application/zip", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "epub": "application/epub+zip", "mp3": "audio/mpeg", "ogg": "audio/ogg", "mp4": "video/mp4",
}
DEFAULT_MIME = "application/octet-stream"
FILE_EXTENSIONS = "pdf|zip|rar|gz|7z|doc|docx|xls|xlsx|ppt|pptx|epub|mp3|mp4|png|jpg|jpeg|gif|webp|csv|txt|apk"


def url_extension(url: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]*)$", 1)
    ext = F.regexp_extract(name, r"\.?([^.]*)$", 1)
    return F.when((ext != "") & (F.length(ext) <= 5), F.lower(ext))


def file_type_of(head: Column, content_type: Column, url: Column) -> Column:
    """Struct (mime, ext) from the first bytes, else the server's type, else the address, else unknown."""
    hexed = F.hex(F.substring(head, 1, 16))
    shown = F.lower(F.ltrim(F.decode(F.substring(head, 1, 16), "ISO-8859-1")))

    def kind(mime: Column, ext: Column) -> Column:
        return F.struct(mime.alias("mime"), ext.alias("ext"))

    long_enough = F.length(head) >= 4
    found = F.lit(None).cast("struct<mime:string,ext:string>")
    for pattern, mime, ext in reversed(MAGIC):
        found = F.when(long_enough & hexed.rlike("^" + pattern), kind(F.lit(mime), F.lit(ext))).otherwise(found)
    html = long_enough & (shown.startswith("<!doctype html") | shown.startswith("<html"))
    found = F.coalesce(found, F.when(html, kind(F.lit("text/html"), F.lit("html"))))
    ct = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    by_mime: dict[str, str] = {}
    for ext, mime in MIME.items():
        by_mime.setdefault(mime, ext)
    ext_of = F.create_map(*[F.lit(x) for p in by_mime.items() for x in p])
    mime_of = F.create_map(*[F.lit(x) for p in MIME.items() for x in p])
    ext = url_extension(url)
    return F.coalesce(
        found,
        F.when((ct != "") & ~ct.isin(DEFAULT_MIME, "application/force-download"), kind(ct, F.coalesce(ext_of[ct], ext, F.lit("bin")))),
        F.when(ext.isNotNull(), kind(F.coalesce(mime_of[ext], F.lit(DEFAULT_MIME)), ext)),
        kind(F.lit(DEFAULT_MIME), F.lit("bin")),
    )


def screened(content: Column, limit: int = 50 * 1024 * 1024) -> Column:
    """Why a file is refused: too_large, empty, executable; null if it passes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.length(content) > limit, "too_large").when(F.length(content) == 0, "empty").when(head.rlike("^(4D5A|7F454C46|23212F|3C3F706870)"), "executable")


def pdf_verdict(content: Column) -> Column:
    """NotPdf, Truncated or Complete by the header within the first 1024 bytes and the end mark in the last 2048."""
    n = F.length(content)
    head, tail = F.hex(F.substring(content, 1, 1024)), F.hex(F.right(content, F.lit(2048)))
    return F.when((n < 32) | ~head.contains("255044462D"), "NotPdf").when(~tail.contains("2525454F46"), "Truncated").otherwise("Complete")


def pdf_links(html: Column, limit: int = 5) -> Column:
    """Distinct addresses of PDFs in href, src, content and meta-refresh, in order, the first ``limit``."""
    attrs = F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src|content)\s*=\s*["']([^"']+?\.pdf(?:\?[^"']*)?)["']"""), F.lit(1))
    refresh = F.regexp_extract_all(html, F.lit(r"""(?i)url=([^"'>\s]+\.pdf[^"'>\s]*)"""), F.lit(1))
    return F.slice(F.array_distinct(F.transform(F.concat(attrs, refresh), lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))), 1, limit)


def file_link(html: Column) -> Column:
    """The first link to a file of a known kind in the first 512 Ki characters."""
    pattern = rf"""(?i)(?:href|src|content)\s*=\s*["']([^"']+?\.(?:{FILE_EXTENSIONS})(?:\?[^"']*)?)["']"""
    return F.nullif(F.trim(F.replace(F.regexp_extract(F.substring(html, 1, 512 * 1024), pattern, 1), F.lit("&amp;"), F.lit("&"))), F.lit(""))


PAGES = [(-1, "https://x.org/a", '<a href="/f/a.pdf?x=1&amp;y=2">a</a><img src=\'b.PNG\'><a href="/f/a.pdf?x=1&amp;y=2">again</a><meta http-equiv="refresh" content="0;url=/next.pdf">'), (-2, "https://x.org/doc.zip?d=1", "<html>none</html>"), (-3, "https://x.org/noext", "plain"), (-4, "https://x.org/c.PDF#top", "%PDF-1.7 ..."), (-5, "https://x.org/z.longext", "<a href='c.csv'>")]
HEADS = ("255044462D312E34", "4D5A", "", "7F454C46", "3C3F706870")
FILES = [(1, "255044462D312E370A" + "00" * 40 + "2525454F460A"), (2, "255044462D312E370A" + "00" * 40), (3, "4D5A9000"), (4, ""), (5, "7F454C4602"), (6, "00" * 40), (7, "3C3F70687020")]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(frame(spark, PAGES, "page_id long, url string, html string"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(pdf_links(F.col("html")), " ").alias("links"))


def html_file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", file_link(F.col("html")).alias("link"))


def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = F.when(F.col("page_id") % 3 == 0, "text/csv; charset=utf-8").when(F.col("page_id") % 3 == 1, DEFAULT_MIME)
    rows = _pages(spark, sf_dir).select("page_id", file_type_of(F.encode(F.when(F.col("page_id") % 2 == 0, F.substring("html", 3, 30)).otherwise(F.substring("html", 1, 30)), "UTF-8"), server, F.col("url")).alias("t"))
    return rows.select("page_id", "t.*")


def file_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal files, and every page's bytes behind one of five heads."""
    content, k = F.unhex("hexed"), F.col("page_id")
    head = F.get(F.array(*map(F.lit, HEADS)), (k % len(HEADS)).cast("int"))
    pages = read(spark, sf_dir, "pages").select((k + 1000).alias("id"), F.concat(head, F.hex(F.encode("html", "UTF-8")), F.when(k % 2 == 0, "2525454F46").otherwise("")).alias("hexed"))
    return frame(spark, FILES, "id long, hexed string").unionByName(pages).select("id", screened(content).alias("refused"), pdf_verdict(content).alias("verdict"))


QUERIES = {f.__name__: f for f in (html_links, html_file_links, file_type, file_screen)}
_P = f"p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {values(PAGES, 'a, b, c', 'x')})"
_MAGIC = " ".join(f"WHEN regexp_matches(h, '^{p}') THEN '{m} {e}'" for p, m, e in MAGIC)
_MIMES = values(list(MIME.items()), "e, m", "mm")
_MORE_FILES = f"SELECT page_id + 1000, {list(HEADS)}[page_id % {len(HEADS)} + 1] || hex(html) || CASE WHEN page_id % 2 = 0 THEN '2525454F46' ELSE '' END FROM pages"
ORACLE_SQL = {
    "html_links": f"""WITH {_P}, l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)(?:href|src|content)\\s*=\\s*["'']([^"'']+?\\.pdf(?:\\?[^"'']*)?)["'']', 1) || regexp_extract_all(html, '(?i)url=([^"''>\\s]+\\.pdf[^"''>\\s]*)', 1), lambda x: trim(replace(x, '&amp;', '&'))) AS l FROM p)
 SELECT page_id, array_to_string((list_filter(l, lambda x, i: list_position(l, x) = i))[1:5], ' ') AS links FROM l""",
    "html_file_links": f"""WITH {_P} SELECT page_id, nullif(trim(replace(regexp_extract(left(html, 524288), '(?i)(?:href|src|content)\\s*=\\s*["'']([^"'']+?\\.(?:{FILE_EXTENSIONS})(?:\\?[^"'']*)?)["'']', 1), '&amp;', '&')), '') AS link FROM p""",
    "file_type": f"""WITH {_P}, a AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN substr(html, 3, 30) ELSE substr(html, 1, 30) END AS t, CASE WHEN page_id % 3 = 0 THEN 'text/csv' END AS ct FROM p),
 b AS (SELECT *, left(hex(encode(t)), 32) AS h, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([^/]*)$', 1), '\\.?([^.]*)$', 1)) AS x FROM a),
 c AS (SELECT *, CASE WHEN octet_length(encode(t)) < 4 THEN NULL {_MAGIC} WHEN regexp_matches(lower(ltrim(left(t, 16))), '^(<!doctype html|<html)') THEN 'text/html html' END AS g, CASE WHEN x <> '' AND length(x) <= 5 THEN x END AS e FROM b)
 SELECT page_id, CASE WHEN g IS NOT NULL THEN split_part(g, ' ', 1) WHEN ct IS NOT NULL THEN ct WHEN e IS NOT NULL THEN coalesce((SELECT m FROM {_MIMES} WHERE mm.e = c.e), '{DEFAULT_MIME}') ELSE '{DEFAULT_MIME}' END AS mime,
 CASE WHEN g IS NOT NULL THEN split_part(g, ' ', 2) WHEN ct IS NOT NULL THEN 'csv' WHEN e IS NOT NULL THEN e ELSE 'bin' END AS ext FROM c""",
    "file_screen": f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN h = '' THEN 'empty' WHEN regexp_matches(h, '^(4D5A|7F454C46|23212F|3C3F706870)') THEN 'executable' END AS refused, CASE WHEN length(h) < 64 OR NOT contains(left(h, 2048), '255044462D') THEN 'NotPdf' WHEN NOT contains(right(h, 4096), '2525454F46') THEN 'Truncated' ELSE 'Complete' END AS verdict FROM {values_and(FILES, 'id, h', 'f', _MORE_FILES)}",
}
