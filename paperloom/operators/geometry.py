"""Boxes on pages: hits, overlaps, labels near fields, turned pages, shapes, and edits of a page list.

Boxes meet regions by page and cell of a grid (``grid``), so a dense page costs what its boxes cost.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.fields import is_field_label, printed_label
from paperloom.operators.grid import boxes_in_cells, in_cells, shared_cell, with_cell
from paperloom.operators.pages import boxes
from paperloom.sources.tables import read

HISTORY = 200
ELEMENT = "text string, x double, y double, w double, h double, fontSize double, fontName string, bold boolean, italic boolean, source string, confidence double"


def _holds(r: str, x: Column, y: Column) -> Column:
    return (x >= F.col(f"{r}.x")) & (x < F.col(f"{r}.x") + F.col(f"{r}.w")) & (y >= F.col(f"{r}.y")) & (y < F.col(f"{r}.y") + F.col(f"{r}.h"))


def _same_cell(a: str, b: str) -> Column:
    return (F.col(f"{a}.page") == F.col(f"{b}.page")) & (F.col(f"{a}.cell") == F.col(f"{b}.cell"))


def hit_test(elements: DataFrame, points: DataFrame) -> DataFrame:
    """(page, point, idx): the topmost element (highest idx) under each point; points without one are left out."""
    e, p = boxes_in_cells(elements).alias("e"), with_cell(points, F.col("x"), F.col("y")).alias("p")
    hits = p.join(e, _same_cell("e", "p") & _holds("e", F.col("p.x"), F.col("p.y")))
    return hits.groupBy("p.page", "p.point").agg(F.max("e.idx").alias("idx"))


def overlapping(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, idx): elements and regions that share an area."""
    e, r = boxes_in_cells(elements).alias("e"), boxes_in_cells(regions).alias("r")
    across = (F.col("e.x") < F.col("r.x") + F.col("r.w")) & (F.col("r.x") < F.col("e.x") + F.col("e.w"))
    down = (F.col("e.y") < F.col("r.y") + F.col("r.h")) & (F.col("r.y") < F.col("e.y") + F.col("e.h"))
    return e.join(r, _same_cell("e", "r") & shared_cell("e", "r") & across & down & (F.col("e.w") > 0) & (F.col("e.h") > 0)).select("e.page", "r.region", "e.idx")


def kept_words(words: DataFrame, erased: DataFrame) -> DataFrame:
    """Words whose centre no erased box holds."""
    w, r = with_cell(words, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2).alias("w"), boxes_in_cells(erased).alias("r")
    return w.join(r, _same_cell("w", "r") & _holds("r", F.col("w.x") + F.col("w.w") / 2, F.col("w.y") + F.col("w.h") / 2), "left_anti").drop("cell")


def near_labels(fields: DataFrame, words: DataFrame) -> DataFrame:
    """(page, region, label): the nearest line of words just above a field that starts over it, else the words just left of it in its line; null if none."""
    tall = fields.withColumn("fh", F.when(F.col("h") <= 0, 0.02).otherwise(F.col("h")))
    h, x, slack = F.col("fh"), F.col("x"), 1e-9
    bottom, right = F.col("w.y") + F.col("w.h"), F.col("w.x") + F.col("w.w")

    def pairs(is_above: bool, fields_: DataFrame, words_: DataFrame, holds: Column) -> DataFrame:
        both = fields_.alias("f").join(words_.alias("w"), _same_cell("f", "w") & holds)
        return both.select("f.page", "f.region", "fh", F.col("w.x").alias("x"), "w.idx", "w.word", F.lit(is_above).alias("above"), F.lit(not is_above).alias("beside"), bottom.alias("bottom"))

    # A word above by its left and bottom, one beside by its right and middle: each is in one cell.
    over_it = in_cells(tall, x - h * 0.5 - slack, F.col("y") - h * 1.6 - slack, x + F.col("w") + slack, F.col("y") + h * 0.2 + slack)
    above = (bottom <= F.col("f.y") + h * 0.2) & (bottom >= F.col("f.y") - h * 1.6) & (F.col("w.x") >= F.col("f.x") - h * 0.5) & (F.col("w.x") < F.col("f.x") + F.col("f.w"))
    middle = F.col("y") + F.col("h") / 2
    left_of_it = in_cells(tall, x - 0.35 - slack, middle - h * 0.6 - slack, x + 0.002 + slack, middle + h * 0.6 + slack)
    beside = (F.abs(F.col("w.y") + F.col("w.h") / 2 - (F.col("f.y") + F.col("f.h") / 2)) < h * 0.6) & (right <= F.col("f.x") + 0.002) & (right > F.col("f.x") - 0.35)
    pairs = pairs(True, over_it, with_cell(words, x, F.col("y") + F.col("h")), above).union(pairs(False, left_of_it, with_cell(words, x + F.col("w"), middle), beside))
    word = F.struct("x", "idx", "word")
    found = pairs.groupBy("page", "region").agg(F.max(F.when(F.col("above"), F.col("bottom"))).alias("nearest"), F.first("fh").alias("fh"), F.collect_list(F.when(F.col("above"), F.struct("bottom", word.alias("w")))).alias("over"), F.collect_list(F.when(F.col("beside"), word)).alias("left"))

    def line(ws: Column) -> Column:
        return F.nullif(printed_label(F.array_join(F.transform(F.array_sort(ws), lambda x: x["word"]), " ")), F.lit(""))

    over = F.transform(F.filter("over", lambda o: F.abs(o["bottom"] - F.col("nearest")) < F.col("fh") * 0.5), lambda o: o["w"])
    named = found.select("page", "region", F.coalesce(line(over), line(F.col("left"))).alias("label"))
    return fields.select("page", "region").join(named, ["page", "region"], "left")


def display_rect(box: dict[str, Column], crop: tuple[float, float, float, float], rotate: Column) -> Column:
    """Struct (left, top, right, bottom), 0 to 1 on the shown page, of a box (x0, y0, x1, y1) in page units with y upwards."""
    r = F.pmod(rotate, F.lit(360))

    def shown(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = (x - crop[0]) / (crop[2] - crop[0]), (y - crop[1]) / (crop[3] - crop[1])
        across = F.when(r == 90, v).when(r == 180, 1 - u).when(r == 270, 1 - v).otherwise(u)
        return across, F.when(r == 90, u).when(r == 180, v).when(r == 270, 1 - u).otherwise(1 - v)

    (ax, ay), (bx, by) = shown(box["x0"], box["y0"]), shown(box["x1"], box["y1"])
    return F.struct(F.least(ax, bx).alias("left"), F.least(ay, by).alias("top"), F.greatest(ax, bx).alias("right"), F.greatest(ay, by).alias("bottom"))


def source_rect(rect: Column, turns: Column) -> Column:
    """A shown box (left, top, right, bottom) on a page that was turned clockwise, as it lies on the source page, cut at the edges; null if nothing is left."""
    cut = {k: F.least(F.greatest(rect[k], F.lit(0.0)), F.lit(1.0)) for k in ("left", "top", "right", "bottom")}
    t = F.pmod(turns, F.lit(4))

    def pick(*options: Column) -> Column:
        return F.when(t == 0, options[0]).when(t == 1, options[1]).when(t == 2, options[2]).otherwise(options[3])

    out = {
        "left": pick(cut["left"], cut["top"], 1 - cut["right"], 1 - cut["bottom"]),
        "top": pick(cut["top"], 1 - cut["right"], 1 - cut["bottom"], cut["left"]),
        "right": pick(cut["right"], cut["bottom"], 1 - cut["left"], 1 - cut["top"]),
        "bottom": pick(cut["bottom"], 1 - cut["left"], 1 - cut["top"], cut["right"]),
    }
    made = F.struct(*[v.alias(k) for k, v in out.items()])
    return F.when((made["right"] - made["left"] > 0) & (made["bottom"] - made["top"] > 0), made)


def quad_area(points: list[tuple[Column, Column]]) -> Column:
    turned = [a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])]
    return F.abs(sum(turned[1:], turned[0])) / 2


def is_convex(points: list[tuple[Column, Column]]) -> Column:
    """Whether all corners turn the same way; straight ones do not count."""
    p = points + points[:2]
    turns = F.array(*[(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(p, p[1:], p[2:])])
    real = F.filter(turns, lambda t: F.abs(t) >= 1e-9)
    return F.forall(real, lambda t: t > 0) | F.forall(real, lambda t: t < 0)


def tiny_square(text: Column, w: Column, h: Column) -> Column:
    """Checkbox or radio for a small, roughly square box that was read as one to three characters and is no label; else null."""
    t = F.trim(text)
    aspect = F.when(w > 0, h / F.nullif(w, F.lit(0.0))).otherwise(1.0)
    fits = (t != "") & (F.length(t) <= 3) & ~is_field_label(t) & (w < 0.06) & (h < 0.04) & aspect.between(0.6, 1.6)
    return F.when(fits, F.when(t.isin("O", "o", "0"), "radio").otherwise("checkbox"))


# A document's pages as an array of sources; -1 is a blank page.


def page_removed(pages: Column, i: Column) -> Column:
    """The last page stays."""
    return F.when((F.size(pages) <= 1) | (i < 0) | (i >= F.size(pages)), pages).otherwise(F.filter(pages, lambda _, k: k != i))


def _inserted(pages: Column, i: Column, what: Column) -> Column:
    return F.concat(F.slice(pages, F.lit(1), i), what, F.slice(pages, i + 1, F.greatest(F.size(pages) - i, F.lit(0))))


def blank_inserted(pages: Column, i: Column) -> Column:
    return _inserted(pages, F.least(F.greatest(i, F.lit(0)), F.size(pages)), F.array(F.lit(-1)))


def page_duplicated(pages: Column, i: Column) -> Column:
    return F.when((i < 0) | (i >= F.size(pages)), pages).otherwise(_inserted(pages, i + 1, F.array(F.get(pages, i))))


def page_moved(pages: Column, a: Column, b: Column) -> Column:
    n = F.size(pages)
    rest = F.filter(pages, lambda _, k: k != a)
    return F.when((a < 0) | (a >= n) | (b < 0) | (b >= n), pages).otherwise(_inserted(rest, b, F.array(F.get(pages, a))))


def export_slots(only: Column, count: Column) -> Column:
    """In the order given, without repeats and pages that are not there."""
    return F.array_distinct(F.filter(only, lambda i: (i >= 0) & (i < count)))


def clamped_range(first: Column, last: Column, count: Column) -> Column:
    """Struct (first, last) of pages from 1, within the document and not turned round."""
    a = F.least(F.greatest(first, F.lit(1)), count)
    return F.struct(a.alias("first"), F.least(F.greatest(last, a), count).alias("last"))


def keys_after(entries: Column, deleted: Column | None = None, inserted: Column | None = None) -> Column:
    """A map from page to anything after a page was deleted or inserted."""
    if deleted is not None:
        kept = F.map_filter(entries, lambda k, v: k != deleted)
        return F.transform_keys(kept, lambda k, v: F.when(k < deleted, k).otherwise(k - 1))
    return F.transform_keys(entries, lambda k, v: F.when(k < inserted, k).otherwise(k + 1))


def text_elements(items: Column) -> Column:
    """Elements of a JSON array with defaults: confidence within 0 and 1, or by the source; elements without text are dropped."""
    parsed = F.from_json(items, f"array<struct<{ELEMENT.replace(' double', ':double').replace(' string', ':string').replace(' boolean', ':boolean')}>>")

    def element(e: Column) -> Column:
        source = F.when(e["source"].isin("ocr", "estimated"), e["source"]).otherwise("native")
        said = F.when(e["confidence"].isNotNull(), F.least(F.greatest(e["confidence"], F.lit(0.0)), F.lit(1.0)))
        sure = F.coalesce(said, F.when(source == "ocr", 0.55).otherwise(1.0))
        numbers = [F.coalesce(e[c], F.lit(0.0)).alias(c) for c in ("x", "y", "w", "h", "fontSize")]
        return F.struct(F.coalesce(e["text"], F.lit("")).alias("text"), *numbers, e["fontName"].alias("fontName"), *[F.coalesce(e[c], F.lit(False)).alias(c) for c in ("bold", "italic")], source.alias("source"), sure.alias("confidence"))

    return F.filter(F.transform(F.filter(parsed, lambda e: e.isNotNull()), element), lambda e: e["text"] != "")


def undo_history(log: DataFrame, depth: int = HISTORY) -> DataFrame:
    """(owner, id, undoable, redoable) after each entry of an owner's log (owner, ts, id, kind of push, undo or redo).

    What can be undone depends on all before, so owners are dealt, sorted and read as a stream of batches.
    """

    def run(frames):
        owner, undo, redo = None, 0, 0
        for f in frames:
            rows = []
            for key, group in groupby(zip(f["owner"], f["id"], f["kind"]), key=lambda x: x[0]):
                if key != owner:
                    owner, undo, redo = key, 0, 0
                for _, i, kind in group:
                    if kind == "push":
                        undo, redo = min(undo + 1, depth), 0
                    elif kind == "undo" and undo:
                        undo, redo = undo - 1, redo + 1
                    elif kind == "redo" and redo:
                        undo, redo = undo + 1, redo - 1
                    rows.append((key, i, undo, redo))
            yield pd.DataFrame(rows, columns=["owner", "id", "undoable", "redoable"])

    rows = log.select("owner", "ts", "id", "kind").repartition("owner").sortWithinPartitions("owner", "ts", "id").drop("ts")
    return rows.mapInPandas(run, "owner long, id long, undoable long, redoable long")


# Queries over the tables.


def element_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in every region."""
    elements, regions = boxes(spark, sf_dir)
    return hit_test(elements, regions.select("page", F.col("region").alias("point"), (F.col("x") + 0.001).alias("x"), (F.col("y") + 0.001).alias("y")))


def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, regions = boxes(spark, sf_dir)
    return overlapping(elements, regions).groupBy("page", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


def words_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, regions = boxes(spark, sf_dir)
    return kept_words(elements, regions).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, regions = boxes(spark, sf_dir)
    return near_labels(regions, elements)


def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on pages of 600 by 800 that are turned."""
    turn = F.col("l_linenumber") % 5 - 1
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", turn.alias("turn"), (F.col("l_partkey") % 600).cast("double").alias("x0"), (F.col("l_suppkey") % 800).cast("double").alias("y0"), (F.col("l_quantity") * 10).alias("x1"), (F.col("l_quantity") * 12).alias("y1"))
    shown = display_rect({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, (0.0, 0.0, 600.0, 800.0), F.col("turn") * 90)
    rows = li.select("l_orderkey", "l_linenumber", "turn", shown.alias("shown")).withColumn("source", source_rect(F.col("shown"), F.col("turn")))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.col(f"{k}.{c}"), 9).alias(f"{k}_{c}") for k in ("shown", "source") for c in ("left", "top", "right", "bottom")])


def quad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as quads, some dented."""
    a, b, c = F.col("l_partkey") % 50 + 1.0, F.col("l_suppkey") % 40 + 1.0, F.col("l_quantity")
    points = [(F.lit(0.0), F.lit(0.0)), (a, F.lit(0.0)), (a - c / 10, b - c / 5), (F.lit(0.0), b)]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(quad_area(points), 6).alias("area"), is_convex(points).alias("convex"))


def tiny_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, ("O", "q", "ab", "☐", "a word", " 0 ", "", "x"))), (F.col("idx") % 8).cast("int"))
    found = boxes(spark, sf_dir)[0].select("idx", tiny_square(word, F.col("w"), F.col("h")).alias("kind"))
    return found.where("kind IS NOT NULL")


def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of one to six pages, each edited in every way."""
    k = F.col("o_orderkey")
    n, i, j = (k % 6 + 1).cast("int"), (k % 8 - 1).cast("int"), (F.col("o_custkey") % 8 - 1).cast("int")
    o = read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), i.alias("i"), j.alias("j"), F.sequence(F.lit(0), n - 1).alias("p"))
    p, i, j, n = F.col("p"), F.col("i"), F.col("j"), F.col("n")
    entries = F.map_from_arrays(p, F.transform(p, lambda x: x * 10))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    of_map = lambda m: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    span = clamped_range(i, j, n)
    slots = export_slots(F.array(j, i, j, F.lit(0), i + 1), n)
    return o.select("o_orderkey", text(page_removed(p, i)).alias("removed"), text(blank_inserted(p, i)).alias("blank"), text(page_duplicated(p, i)).alias("duplicated"), text(page_moved(p, i, j)).alias("moved"), text(slots).alias("slots"), span["first"].alias("first"), span["last"].alias("last"), of_map(keys_after(entries, deleted=i)).alias("after_delete"), of_map(keys_after(entries, inserted=i)).alias("after_insert"))


def element_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reported text elements, in all states of repair."""
    k = F.col("event_id")
    fields = [(k % 7 != 0, F.concat(F.lit('"text":"t'), k.cast("string"), F.lit('"'))), (k % 2 == 0, F.concat(F.lit('"x":'), (k % 10 / 10).cast("string"))), (k % 3 == 0, F.lit('"source":"ocr"')), (k % 5 == 0, F.concat(F.lit('"confidence":'), (k % 4 - 1).cast("string"))), ((k % 11 == 0) & (k % 5 != 0), F.lit('"confidence":"high"')), (k % 4 == 0, F.lit('"bold":true,"fontSize":12'))]
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.when(c, v) for c, v in fields]), F.lit("}"))
    rows = read(spark, sf_dir, "events").select(k, F.explode(text_elements(F.concat(F.lit("["), body, F.lit("]")))).alias("e"))
    return rows.select("event_id", "e.text", "e.x", "e.fontSize", "e.bold", "e.source", "e.confidence")


def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: errors undo, signups do again."""
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("push")
    return undo_history(read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("id"), kind.alias("kind")), 5)


QUERIES = {f.__name__: f for f in (element_hits, region_overlaps, words_left, field_labels, turned_boxes, quad_shapes, tiny_squares, page_edits, element_json, edit_history)}

_BOX = "e AS (SELECT l_orderkey // 20 AS page, l_orderkey * 10 + l_linenumber AS idx, (l_partkey % 90) / 100 AS x, (l_suppkey % 80) / 100 AS y, l_quantity / 500 AS w, (l_quantity % 3) / 100 AS h, 'w-' || l_partkey AS word FROM lineitem), r AS (SELECT l_orderkey // 20 AS page, l_orderkey AS region, (l_partkey % 90) / 100 AS x, (l_suppkey % 80) / 100 AS y, 0.05::DOUBLE AS w, 0.03::DOUBLE AS h FROM lineitem WHERE l_linenumber = 1)"
_IN = "{0} >= {2}.x AND {0} < {2}.x + {2}.w AND {1} >= {2}.y AND {1} < {2}.y + {2}.h"
_ABOVE = "e.y + e.h <= r.y + r.h * 0.2::DOUBLE AND e.y + e.h >= r.y - r.h * 1.6::DOUBLE AND e.x >= r.x - r.h * 0.5::DOUBLE AND e.x < r.x + r.w"
_BESIDE = "abs(e.y + e.h / 2 - (r.y + r.h / 2)) < r.h * 0.6::DOUBLE AND e.x + e.w <= r.x + 0.002::DOUBLE AND e.x + e.w > r.x - 0.35::DOUBLE"
_CUT = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"
_ORDERS = "o AS (SELECT o_orderkey, o_orderkey % 6 + 1 AS n, o_orderkey % 8 - 1 AS i, o_custkey % 8 - 1 AS j, range(0, o_orderkey % 6 + 1) AS p FROM orders)"
ORACLE_SQL = {
    "element_hits": f"WITH {_BOX} SELECT r.page, r.region AS point, max(idx) AS idx FROM r JOIN e ON e.page = r.page AND {_IN.format('(r.x + 0.001::DOUBLE)', '(r.y + 0.001::DOUBLE)', 'e')} GROUP BY ALL",
    "region_overlaps": f"WITH {_BOX} SELECT e.page, region, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM r JOIN e ON e.page = r.page AND e.w > 0 AND e.h > 0 AND least(e.x + e.w, r.x + r.w) > greatest(e.x, r.x) AND least(e.y + e.h, r.y + r.h) > greatest(e.y, r.y) GROUP BY ALL",
    "words_left": f"WITH {_BOX} SELECT page, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page = e.page AND {_IN.format('e.x + e.w / 2', 'e.y + e.h / 2', 'r')}) GROUP BY page",
    "field_labels": f"""WITH {_BOX}, a AS (SELECT r.page, region, e.x, idx, word, e.y + e.h AS b, max(e.y + e.h) OVER (PARTITION BY r.page, region) AS nearest FROM r JOIN e ON e.page = r.page AND {_ABOVE}),
 al AS (SELECT page, region, string_agg(word, ' ' ORDER BY x, idx, word) AS label FROM a WHERE abs(b - nearest) < 0.03::DOUBLE * 0.5::DOUBLE GROUP BY ALL), bl AS (SELECT r.page, region, string_agg(word, ' ' ORDER BY e.x, idx, word) AS label FROM r JOIN e ON e.page = r.page AND {_BESIDE} GROUP BY ALL)
 SELECT r.page, r.region, coalesce(al.label, bl.label) AS label FROM r LEFT JOIN al USING (page, region) LEFT JOIN bl USING (page, region)""",
    "turned_boxes": f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 - 1 AS t, (l_partkey % 600) / 600 AS u0, (l_suppkey % 800) / 800 AS v0, l_quantity * 10 / 600 AS u1, l_quantity * 12 / 800 AS v1 FROM lineitem),
 c AS (SELECT *, CASE (t + 4) % 4 WHEN 1 THEN [v0, u0, v1, u1] WHEN 2 THEN [1 - u0, v0, 1 - u1, v1] WHEN 3 THEN [1 - v0, 1 - u0, 1 - v1, 1 - u1] ELSE [u0, 1 - v0, u1, 1 - v1] END AS q FROM b),
 s AS (SELECT l_orderkey, l_linenumber, (t + 4) % 4 AS t, least(q[1], q[3]) AS l, least(q[2], q[4]) AS o, greatest(q[1], q[3]) AS r, greatest(q[2], q[4]) AS b FROM c),
 k AS (SELECT *, {_CUT.format('l')} AS cl, {_CUT.format('o')} AS co, {_CUT.format('r')} AS cr, {_CUT.format('b')} AS cb FROM s),
 m AS (SELECT *, CASE t WHEN 0 THEN [cl, co, cr, cb] WHEN 1 THEN [co, 1 - cr, cb, 1 - cl] WHEN 2 THEN [1 - cr, 1 - cb, 1 - cl, 1 - co] ELSE [1 - cb, cl, 1 - co, cr] END AS z FROM k),
 g AS (SELECT *, CASE WHEN z[3] - z[1] > 0 AND z[4] - z[2] > 0 THEN z END AS y FROM m)
 SELECT l_orderkey, l_linenumber, {', '.join(f"round({v}, 9) AS shown_{n}" for v, n in zip(('l', 'o', 'r', 'b'), ('left', 'top', 'right', 'bottom')))}, {', '.join(f"round(y[{i + 1}], 9) AS source_{n}" for i, n in enumerate(('left', 'top', 'right', 'bottom')))} FROM g""",
    "quad_shapes": """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 + 1.0::DOUBLE AS a, l_suppkey % 40 + 1.0::DOUBLE AS b, l_quantity AS c FROM lineitem), p AS (SELECT *, a - c / 10 AS x, b - c / 5 AS y FROM q),
 t AS (SELECT *, [a * y, (x - a) * (b - y) - y * (0 - x), (0 - x) * (0 - b) - (b - y) * 0, b * a] AS turns FROM p)
 SELECT l_orderkey, l_linenumber, round(abs(a * y + x * b) / 2, 6) AS area, len(list_filter(turns, lambda z: z <= -1e-9)) = 0 OR len(list_filter(turns, lambda z: z >= 1e-9)) = 0 AS convex FROM t""",
    "tiny_squares": f"WITH {_BOX}, t AS (SELECT idx, CASE idx % 8 WHEN 1 THEN 'q' WHEN 2 THEN 'ab' WHEN 5 THEN '0' END AS t, w, h FROM e) SELECT idx, CASE t WHEN '0' THEN 'radio' ELSE 'checkbox' END AS kind FROM t WHERE t IS NOT NULL AND w < 0.06::DOUBLE AND h < 0.04::DOUBLE AND h / w BETWEEN 0.6::DOUBLE AND 1.6::DOUBLE",
    "page_edits": f"""WITH {_ORDERS}, s AS (SELECT *, [j, i, j, 0, i + 1] AS want FROM o), x AS (SELECT *, i < 0 OR i >= n AS out, list_filter(p, lambda q: q <> i) AS rest, greatest(least(i, n), 0) AS ins, least(greatest(i, 1), n) AS a FROM s)
 SELECT o_orderkey, array_to_string(CASE WHEN n <= 1 OR out THEN p ELSE rest END, ' ') AS removed, array_to_string(p[:ins] || [-1::BIGINT] || p[ins + 1:], ' ') AS blank, array_to_string(CASE WHEN out THEN p ELSE p[:i + 1] || [p[i + 1]] || p[i + 2:] END, ' ') AS duplicated,
 array_to_string(CASE WHEN out OR j < 0 OR j >= n THEN p ELSE rest[:j] || [i] || rest[j + 1:] END, ' ') AS moved, array_to_string(list_filter(want, lambda q, k: q >= 0 AND q < n AND list_position(want, q) = k), ' ') AS slots, CAST(a AS INTEGER) AS first, CAST(least(greatest(j, a), n) AS INTEGER) AS last,
 array_to_string(list_transform(rest, lambda q: (CASE WHEN q < i THEN q ELSE q - 1 END) || ':' || q * 10), ' ') AS after_delete, array_to_string(list_transform(p, lambda q: (CASE WHEN q < i THEN q ELSE q + 1 END) || ':' || q * 10), ' ') AS after_insert FROM x""",
    "element_json": "SELECT event_id, 't' || event_id AS text, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 10 / 10 ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN event_id % 4 = 0 THEN 12 ELSE 0 END AS DOUBLE) AS fontSize, event_id % 4 = 0 AS bold, CASE WHEN event_id % 3 = 0 THEN 'ocr' ELSE 'native' END AS source, CASE WHEN event_id % 5 = 0 THEN CAST(least(greatest(event_id % 4 - 1, 0), 1) AS DOUBLE) WHEN event_id % 3 = 0 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM events WHERE event_id % 7 <> 0",
    "edit_history": """WITH RECURSIVE l AS (SELECT user_id AS owner, event_id AS id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'push' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 h AS (SELECT owner, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS r FROM (SELECT DISTINCT owner FROM l)
 UNION ALL SELECT l.owner, l.n, l.id, CASE kind WHEN 'push' THEN least(u + 1, 5) WHEN 'undo' THEN greatest(u - 1, 0) ELSE u + least(r, 1) END, CASE kind WHEN 'push' THEN 0 WHEN 'undo' THEN r + least(u, 1) ELSE greatest(r - 1, 0) END FROM h JOIN l ON l.owner = h.owner AND l.n = h.n + 1)
 SELECT owner, id, u AS undoable, r AS redoable FROM h WHERE n > 0""",
}
