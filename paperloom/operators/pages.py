"""Page lists and document structure: ranges, moves, running numbers, outlines, geometry of text and regions, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, values_and
from paperloom.operators.grid import boxes_in_cells, with_cell

COVERAGE = 0.15


def page_list(spec: Column, count: Column) -> Column:
    """0-based pages of a specification such as ``1-3, 5``: distinct, sorted; null if a part is no page of the document.

    Blank parts are skipped and turned ranges are read both ways.
    """
    parts = F.filter(F.transform(F.split(F.trim(spec), ","), lambda p: F.trim(p)), lambda p: p != "")

    def bound(p: Column, last: bool) -> Column:
        piece = F.when(p.contains("-"), F.trim(F.regexp_extract(p, "^[^-]*-(.*)$" if last else "^([^-]*)-", 1))).otherwise(p)
        return F.when(piece.rlike("^[+-]?[0-9]{1,9}$"), piece.try_cast("int"))

    def good(p: Column) -> Column:
        return F.coalesce(bound(p, False).between(1, count) & bound(p, True).between(1, count), F.lit(False))

    def pages(p: Column) -> Column:
        a, b = bound(p, False), bound(p, True)
        return F.sequence(F.least(a, b) - 1, F.greatest(a, b) - 1)

    return F.when(F.forall(parts, good), F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(parts, good), pages)))))


def page_spec(rows: DataFrame, group: str, page: str) -> DataFrame:
    """(group, spec): 0-based pages as compact 1-based ranges."""
    order = Window.partitionBy(group).orderBy(page)
    runs = rows.select(group, page).distinct().withColumn("run", F.col(page) - F.row_number().over(order))
    ends = runs.groupBy(group, "run").agg((F.min(page) + 1).alias("a"), (F.max(page) + 1).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return ends.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("spec"))


def moved(i: Column, a: int, b: int) -> Column:
    """Where page i stands after page a was moved to place b."""
    inside = F.when((i > a) & (i <= b), i - 1) if a < b else F.when((i >= b) & (i < a), i + 1)
    return F.when(i == a, b).otherwise(F.coalesce(inside, i))


def running_line(template: str, index: Column, count: Column, skip_first: bool = False, start: int = 1, digits: int = 6, prefix: str = "", suffix: str = "") -> Column:
    """The template with {bates}, {page} and {pages} filled in."""
    shown = F.greatest(index - 1 if skip_first else index, F.lit(0))
    number = (F.lit(max(start, 0)) + shown).cast("string")
    width = min(max(digits, 1), 8)
    bates = F.concat(F.lit(prefix), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number), F.lit(suffix))
    x = F.replace(F.lit(template), F.lit("{bates}"), bates)
    return F.replace(F.replace(x, F.lit("{page}"), (index + 1).cast("string")), F.lit("{pages}"), count.cast("string"))


def outline_parents(headings: DataFrame) -> DataFrame:
    """Adds parent: the nearest earlier heading of the same document with a smaller level.

    The latest place of each level so far is kept as one column per level (there are six), so no
    heading is compared with all others.
    """
    order = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.max(F.when(F.col("level") == n, F.col("idx"))).over(order).alias(f"l{n}") for n in range(1, 7)]
    best = F.greatest(F.lit(-1), *[F.when(F.col("level") > n, F.col(f"l{n}")) for n in range(1, 7)])
    return headings.select("*", *seen).withColumn("parent", F.nullif(best, F.lit(-1))).drop(*[f"l{n}" for n in range(1, 7)])


def sections(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds section: the heading with the highest page up to this one, of several the last in the document."""
    marks = headings.select("doc", "page", F.lit(0).alias("kind"), "idx", "title").unionByName(pages.select("doc", "page", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("title")))
    order = Window.partitionBy("doc").orderBy("page", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("section", F.last("title", True).over(order)).where("kind = 1").select("doc", "page", "section")


def covered(elements: DataFrame, regions: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Elements of which a single region of their page covers the threshold; elements without area by their corner."""
    # Both meet in every cell that they share, so an element is told from others by a number.
    e, r = boxes_in_cells(elements.withColumn("_row", F.monotonically_increasing_id())).alias("e"), boxes_in_cells(regions).alias("r")
    w = F.least(F.col("e.x") + F.col("e.w"), F.col("r.x") + F.col("r.w")) - F.greatest("e.x", "r.x")
    h = F.least(F.col("e.y") + F.col("e.h"), F.col("r.y") + F.col("r.h")) - F.greatest("e.y", "r.y")
    area = F.col("e.w") * F.col("e.h")
    corner = (F.col("e.x") >= F.col("r.x")) & (F.col("e.x") < F.col("r.x") + F.col("r.w")) & (F.col("e.y") >= F.col("r.y")) & (F.col("e.y") < F.col("r.y") + F.col("r.h"))
    flat = (F.col("e.w") <= 0) | (F.col("e.h") <= 0)
    hit = F.when(flat, corner).otherwise((w > 0) & (h > 0) & (w * h >= threshold * area))
    met = e.join(r, (F.col("e.page") == F.col("r.page")) & (F.col("e.cell") == F.col("r.cell")) & hit, "left_semi")
    return met.dropDuplicates(["_row"]).drop("_row", "cell")


def region_needles(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, needle): the phrase under a region and its distinctive words."""
    w, r = with_cell(words, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2).alias("w"), boxes_in_cells(regions).alias("r")
    cx, cy = F.col("w.x") + F.col("w.w") / 2, F.col("w.y") + F.col("w.h") / 2
    inside = (cx >= F.col("r.x")) & (cx < F.col("r.x") + F.col("r.w")) & (cy >= F.col("r.y")) & (cy < F.col("r.y") + F.col("r.h"))
    hits = w.join(r, (F.col("w.page") == F.col("r.page")) & (F.col("w.cell") == F.col("r.cell")) & inside).select("w.page", "r.region", "w.idx", "w.word")
    phrase = hits.groupBy("page", "region").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")).alias("needle")).where(F.length("needle") >= 4)
    token = F.regexp_replace("word", r"""^[.,;:()\[\]{}"']+|[.,;:()\[\]{}"']+$""", "")
    single = hits.select("page", "region", token.alias("needle")).where((F.length("needle") >= 4) & (F.col("needle").rlike("[0-9@_-]") | (F.length("needle") >= 10)))
    return phrase.unionByName(single).distinct()


def area_error(row: dict[str, Column], pages: Column) -> Column:
    """Why a redaction area is refused; null if it is good. Corners may come in any order."""
    coords = [row[c] for c in ("x0", "y0", "x1", "y1")]
    bad = F.lit(False)
    for c in coords:
        bad = bad | c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    return F.when(row["page"].isNull() | (row["page"] < 0) | (row["page"] >= pages), "page").when(bad, "coordinates").when((coords[0] == coords[2]) | (coords[1] == coords[3]), "empty")


def otsu(histogram: DataFrame) -> DataFrame:
    """(image, threshold) of (image, bin, n) histograms with bins 0 to 255: the first bin with the largest between-class variance; 127 where no cut splits the pixels."""
    upto = Window.partitionBy("image").orderBy("bin")
    all_of = Window.partitionBy("image")
    n, s = F.col("n").cast("double"), F.col("bin") * F.col("n").cast("double")
    x = histogram.withColumn("wb", F.sum(n).over(upto)).withColumn("sb", F.sum(s).over(upto)).withColumn("total", F.sum(n).over(all_of)).withColumn("all", F.sum(s).over(all_of))
    wf = F.col("total") - F.col("wb")
    mean_gap = F.col("sb") / F.col("wb") - (F.col("all") - F.col("sb")) / F.nullif(wf, F.lit(0.0))
    x = x.withColumn("between", F.when((F.col("wb") > 0) & (wf > 0), F.round(F.col("wb") * wf * mean_gap * mean_gap, 3)))
    best = x.where(F.col("between").isNotNull()).groupBy("image").agg(F.max_by("bin", F.struct("between", (-F.col("bin")).alias("low"))).alias("t"))
    return histogram.select("image").distinct().join(best, "image", "left").select("image", F.coalesce("t", F.lit(127)).cast("long").alias("threshold"))


SPECS = [(i, s) for i, s in enumerate(["1-3, 5, 8-10", " 1 - 3 , , 5 ", "1-3,2-4", "3-1", "", "  ", "1-x", "0", "11", "10", "-3", "2-"])]
AREAS = [(1, 0, 0.1, 0.1, 0.5, 0.5), (2, 0, 0.5, 0.5, 0.1, 0.1), (3, 0, float("nan"), 0.1, 0.2, 0.2), (4, 0, -0.1, 0.1, 0.2, 0.2), (5, 0, 0.1, 0.1, 1.2, 0.2), (6, 0, 0.1, 0.1, 0.1, 0.2), (7, 3, 0.1, 0.1, 0.2, 0.2), (8, None, 0.1, 0.1, 0.2, 0.2), (9, 0, None, 0.1, 0.2, 0.2), (10, -1, 0.1, 0.1, 0.2, 0.2)]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ends = F.concat((k % 12).cast("string"), F.lit("-"), (k * 7 % 13).cast("string"))
    more = F.when(k % 4 == 0, F.concat(F.lit(", "), (k % 10 + 1).cast("string"))).when(k % 4 == 1, ",").when(k % 16 == 2, " , x").otherwise("")
    orders = _t(spark, sf_dir, "orders").select((k + 1000).alias("id"), F.concat(ends, more).alias("spec"))
    return frame(spark, SPECS, "id long, spec string").unionByName(orders).select("id", F.array_join(F.transform(page_list(F.col("spec"), F.lit(10)), lambda p: p.cast("string")), " ").alias("pages"))


def page_range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_spec(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


def page_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ten that an order's line numbers do not name."""
    named = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("p"))
    return named.select("l_orderkey", F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.lit(9)), "p"), lambda x: x.cast("string")), " ").alias("pages"))


def page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", moved(i, 1, 4).alias("forth"), moved(i, 5, 2).alias("back"), F.when(i != 3, F.when(i < 3, i).otherwise(i - 1)).alias("after_delete"), F.when(i < 3, i).otherwise(i + 1).alias("after_insert")).distinct()


def bates_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("n", n)
    return rows.select("l_orderkey", "l_linenumber", running_line("{bates} - {page}/{pages}", F.col("l_linenumber"), F.col("n"), True, 7, 6, "A-", "x").alias("label"))


def headings_of(pages: DataFrame) -> DataFrame:
    """(doc, idx, page, level, title): h1 to h6 of each page's html; ten html pages make a document."""
    tags = F.regexp_extract_all("html", F.lit("(?i)(<h[1-6])[ >]"), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit("(?i)<h[1-6][^>]*>([^<]*)"), F.lit(1))
    rows = pages.select((F.col("page_id").cast("long") / 10).cast("long").alias("doc"), (F.col("page_id") % 10).alias("page"), F.posexplode(F.arrays_zip(tags.alias("tag"), titles.alias("title"))).alias("k", "x"))
    level = F.substring("x.tag", -1, 1).cast("int") + F.col("page") % 3  # the fixtures hold h1 alone
    return rows.select("doc", (F.col("page") * 100 + F.col("k")).alias("idx"), "page", level.cast("int").alias("level"), F.col("x.title").alias("title"))


def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_parents(headings_of(_t(spark, sf_dir, "pages"))).select("doc", "idx", "level", "parent")


def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    some = headings_of(pages).where("level <> 2")
    return sections(pages.select((F.col("page_id") / 10).cast("long").alias("doc"), (F.col("page_id") % 10).alias("page")), some)


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Elements and regions with made-up places, from line items: all are elements, the first line of an order is a region too.

    Twenty orders make a page, so pages grow in number with the table and not in size.
    """
    li = _t(spark, sf_dir, "lineitem")
    page = F.floor(F.col("l_orderkey") / 20)
    x, y = (F.col("l_partkey") % 90) / 100, (F.col("l_suppkey") % 80) / 100
    elements = li.select(page.alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), x.alias("x"), y.alias("y"), (F.col("l_quantity") / 500).alias("w"), ((F.col("l_quantity") % 3) / 100).alias("h"), F.concat(F.lit("w-"), F.col("l_partkey").cast("string")).alias("word"))
    regions = li.where("l_linenumber = 1").select(page.alias("page"), F.col("l_orderkey").alias("region"), x.alias("x"), y.alias("y"), F.lit(0.05).alias("w"), F.lit(0.03).alias("h"))
    return elements, regions


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, regions = boxes(spark, sf_dir)
    return covered(elements, regions).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


def needle_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, regions = boxes(spark, sf_dir)
    return region_needles(elements, regions)


def redaction_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, n, d: ((F.col(c) % n - d) / 100.0).cast("double")
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1000).alias("id"), (F.col("l_linenumber") % 5 - 1).cast("int").alias("page"), at("l_partkey", 120, 10).alias("x0"), at("l_suppkey", 90, 0).alias("y0"), at("l_quantity", 60, 0).alias("x1"), at("l_suppkey", 45, 0).alias("y1"))
    rows = frame(spark, AREAS, "id long, page int, x0 double, y0 double, x1 double, y1 double").unionByName(li)
    return rows.select("id", area_error({c: F.col(c) for c in rows.columns}, F.lit(2)).alias("error"))


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per brand, a part's price modulo 256 as its gray value."""
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("image"), (F.col("p_retailprice").cast("long") % 256).alias("bin"))
    return otsu(p.groupBy("image", "bin").agg(F.count(F.lit(1)).alias("n")))


_ALL = (page_range_parse, page_range_format, page_invert, page_move, bates_labels, html_outline, outline_sections, region_coverage, needle_words, redaction_areas, otsu_threshold)
QUERIES = {f.__name__: f for f in _ALL}

_HEAD = "x AS (SELECT page_id, regexp_extract_all(html, '(?i)(<h[1-6])[ >]', 1) AS g, regexp_extract_all(html, '(?i)<h[1-6][^>]*>([^<]*)', 1) AS t FROM pages), h AS (SELECT page_id // 10 AS doc, page_id % 10 * 100 + k - 1 AS idx, page_id % 10 AS page, CAST(right(g[k], 1) AS INTEGER) + page_id % 10 % 3 AS level, t[k] AS title FROM (SELECT *, unnest(range(1, len(g) + 1)) AS k FROM x))"
_BOX = "e AS (SELECT l_orderkey // 20 AS page, l_orderkey * 10 + l_linenumber AS idx, (l_partkey % 90) / 100 AS x, (l_suppkey % 80) / 100 AS y, l_quantity / 500 AS w, (l_quantity % 3) / 100 AS h, 'w-' || l_partkey AS word FROM lineitem), r AS (SELECT l_orderkey // 20 AS page, l_orderkey AS region, (l_partkey % 90) / 100 AS x, (l_suppkey % 80) / 100 AS y, 0.05::DOUBLE AS w, 0.03::DOUBLE AS h FROM lineitem WHERE l_linenumber = 1)"
_INS = "{0} >= r.x AND {0} < r.x + r.w AND {1} >= r.y AND {1} < r.y + r.h"
_MORE_SPECS = "SELECT o_orderkey + 1000, (o_orderkey % 12) || '-' || (o_orderkey * 7 % 13) || CASE WHEN o_orderkey % 4 = 0 THEN ', ' || (o_orderkey % 10 + 1) WHEN o_orderkey % 4 = 1 THEN ',' WHEN o_orderkey % 16 = 2 THEN ' , x' ELSE '' END FROM orders"
_MORE_AREAS = "SELECT l_orderkey + 1000, l_linenumber % 5 - 1, (l_partkey % 120 - 10) / 100, l_suppkey % 90 / 100, l_quantity % 60 / 100, l_suppkey % 45 / 100 FROM lineitem"
ORACLE_SQL = {
    "page_range_parse": f"WITH s AS (SELECT id, unnest(list_filter(list_transform(string_split(trim(spec), ','), lambda p: trim(p)), lambda p: p <> '')) AS p FROM {values_and(SPECS, 'id, spec', 't', _MORE_SPECS)}), b AS (SELECT id, TRY_CAST(CASE WHEN contains(p, '-') THEN trim(split_part(p, '-', 1)) ELSE p END AS INTEGER) AS a, TRY_CAST(CASE WHEN contains(p, '-') THEN trim(substr(p, instr(p, '-') + 1)) ELSE p END AS INTEGER) AS b FROM s), o AS (SELECT id, bool_and(coalesce(a BETWEEN 1 AND 10 AND b BETWEEN 1 AND 10, false)) AS good, flatten(list(range(least(a, b) - 1, greatest(a, b)))) AS p FROM b GROUP BY id) SELECT CAST(t.id AS BIGINT) AS id, CASE WHEN o.id IS NULL THEN '' WHEN good THEN array_to_string(list_sort(list_distinct(p)), ' ') END AS pages FROM {values_and(SPECS, 'id, spec', 't', _MORE_SPECS)} LEFT JOIN o ON o.id = t.id",
    "page_range_format": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM d), e AS (SELECT l_orderkey, min(l_linenumber) + 1 AS a, max(l_linenumber) + 1 AS b FROM r GROUP BY l_orderkey, run) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS spec FROM e GROUP BY l_orderkey",
    "page_invert": "SELECT l_orderkey, array_to_string(list_filter(range(0, 10), lambda i: NOT list_contains(p, i)), ' ') AS pages FROM (SELECT l_orderkey, list(l_linenumber) AS p FROM lineitem GROUP BY l_orderkey)",
    "page_move": "SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN i = 1 THEN 4 WHEN i > 1 AND i <= 4 THEN i - 1 ELSE i END AS forth, CASE WHEN i = 5 THEN 2 WHEN i >= 2 AND i < 5 THEN i + 1 ELSE i END AS back, CASE WHEN i < 3 THEN i WHEN i > 3 THEN i - 1 END AS after_delete, CASE WHEN i < 3 THEN i ELSE i + 1 END AS after_insert FROM (SELECT *, l_linenumber AS i FROM lineitem)",
    "bates_labels": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber, 'A-' || lpad(CAST(7 + greatest(l_linenumber - 1, 0) AS VARCHAR), 6, '0') || 'x - ' || (l_linenumber + 1) || '/' || count(*) OVER (PARTITION BY l_orderkey) AS label FROM d",
    "html_outline": f"WITH {_HEAD} SELECT doc, idx, CAST(level AS INTEGER) AS level, (SELECT max(p.idx) FROM h p WHERE p.doc = h.doc AND p.idx < h.idx AND p.level < h.level) AS parent FROM h",
    "outline_sections": f"WITH {_HEAD} SELECT page_id // 10 AS doc, page_id % 10 AS page, (SELECT arg_max(title, (h.page, h.idx)) FROM h WHERE h.doc = page_id // 10 AND h.page <= page_id % 10 AND level <> 2) AS section FROM pages",
    "region_coverage": f"WITH {_BOX} SELECT page, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.page = e.page AND CASE WHEN e.w <= 0 OR e.h <= 0 THEN {_INS.format('e.x', 'e.y')} ELSE least(e.x + e.w, r.x + r.w) - greatest(e.x, r.x) > 0 AND least(e.y + e.h, r.y + r.h) - greatest(e.y, r.y) > 0 AND (least(e.x + e.w, r.x + r.w) - greatest(e.x, r.x)) * (least(e.y + e.h, r.y + r.h) - greatest(e.y, r.y)) >= 0.15::DOUBLE * (e.w * e.h) END) GROUP BY page",
    "needle_words": f"WITH {_BOX}, k AS (SELECT e.page, region, idx, word FROM e JOIN r ON r.page = e.page AND {_INS.format('e.x + e.w / 2', 'e.y + e.h / 2')}) SELECT page, region, string_agg(word, ' ' ORDER BY idx, word) AS needle FROM k GROUP BY page, region HAVING length(needle) >= 4 UNION SELECT page, region, word FROM k WHERE length(word) >= 4",
    "redaction_areas": f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN page IS NULL OR page < 0 OR page >= 2 THEN 'page' WHEN NOT coalesce(list_min([x0, y0, x1, y1]) >= 0 AND list_max([x0, y0, x1, y1]) <= 1 AND x0 + y0 + x1 + y1 IS NOT NULL, false) THEN 'coordinates' WHEN x0 = x1 OR y0 = y1 THEN 'empty' END AS error FROM {values_and([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in AREAS], 'id, page, x0, y0, x1, y1', 'a', _MORE_AREAS)}",
    "otsu_threshold": "WITH n AS (SELECT p_brand AS image, CAST(floor(p_retailprice) AS BIGINT) % 256 AS bin, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT image, bin, CAST(sum(n) OVER u AS DOUBLE) AS wb, CAST(sum(bin * n) OVER u AS DOUBLE) AS sb, CAST(sum(n) OVER a AS DOUBLE) AS total, CAST(sum(bin * n) OVER a AS DOUBLE) AS s FROM n WINDOW u AS (PARTITION BY image ORDER BY bin), a AS (PARTITION BY image)), v AS (SELECT image, bin, round(wb * (total - wb) * (sb / wb - (s - sb) / (total - wb)) * (sb / wb - (s - sb) / (total - wb)), 3) AS b FROM c WHERE total > wb) SELECT n.image, coalesce(min(t), 127) AS threshold FROM (SELECT DISTINCT image FROM n) n LEFT JOIN (SELECT image, arg_max(bin, (b, -bin)) AS t FROM v GROUP BY image) USING (image) GROUP BY n.image",
}
