"""Placing objects on a page: align, distribute, snap to each other and to the page's guides.

Objects are rows (page, id, left, top, right, bottom) in shares of the page. Snapping looks for the nearest anchor
in one dimension by sorting, not by comparing objects in pairs: an object has three anchors an axis, so the nearest
anchor of another one is among the three before and the three behind in order. A page's anchors are cut into
cells, each with the anchors of its neighbours, so a dense page is sorted by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.tables import read

#: How near an object and the page draw others.
OBJECT_REACH, GUIDE_REACH = 0.012, 0.014
#: Reaches that a cell of anchors is wide.
CELL = 8
GUIDES = (0.25, 0.5, 0.75)
_AXES = {"x": ("left", "right"), "y": ("top", "bottom")}
#: Distances are compared to this many decimals, so that equal ones tie in any arithmetic.
_DECIMALS = 9


def aligned(objects: DataFrame, how: str, group: str = "page") -> DataFrame:
    """Each group's objects moved to its common left, hcenter, right, top, vcenter or bottom; a single object stays."""
    axis = "x" if how in ("left", "hcenter", "right") else "y"
    low, high = _AXES[axis]
    whole = Window.partitionBy(group)
    first, last = F.min(low).over(whole), F.max(high).over(whole)
    shift = {low: first - F.col(low), high: last - F.col(high)}.get(how, (first + last - F.col(low) - F.col(high)) / 2)
    return _moved(objects, axis, F.when(F.count(F.lit(1)).over(whole) > 1, shift).otherwise(0.0))


def distributed(objects: DataFrame, axis: str, group: str = "page") -> DataFrame:
    """Centres put at equal steps between the first and the last one; of fewer than three objects none moves. Equal centres keep the order of ids."""
    low, high = _AXES[axis]
    centre = (F.col(low) + F.col(high)) / 2
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(centre, "id")
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(order) - 1
    first, last = F.min(centre).over(whole), F.max(centre).over(whole)
    inner = (n > 2) & (i > 0) & (i < n - 1)
    return _moved(objects, axis, F.when(inner, first + (last - first) / (n - 1) * i - centre).otherwise(0.0))


def _moved(objects: DataFrame, axis: str, shift: Column) -> DataFrame:
    shifted = objects.withColumn("_shift", shift)
    return shifted.withColumns({c: F.col(c) + F.col("_shift") for c in _AXES[axis]}).drop("_shift")


def page_aligned(objects: DataFrame, edge: str) -> DataFrame:
    """The named edge or centre put on the page's: left, right, hcenter, top, bottom, vcenter."""
    axis = "x" if edge in ("left", "hcenter", "right") else "y"
    low, high = _AXES[axis]
    shift = {low: -F.col(low), high: 1 - F.col(high)}.get(edge, 0.5 - (F.col(low) + F.col(high)) / 2)
    return _moved(objects, axis, shift)


def _dealt(anchors: DataFrame, reach: float) -> DataFrame:
    """Adds cell and own: each anchor in its own cell, and in the next one too where that begins within ``reach``."""
    home, before, after = (F.floor((F.col("at") + d) / (reach * CELL)) for d in (0, -reach, reach))
    rows = anchors.select("page", "id", "at", F.explode(F.array_distinct(F.array(home, before, after))).alias("cell"))
    return rows.withColumn("own", F.col("cell") == home)


def nearest_anchors(objects: DataFrame, axis: str, reach: float = OBJECT_REACH) -> DataFrame:
    """(page, id, guide, shift): the nearest anchor of another object of the page, closer than ``reach``; of equally near ones the smaller guide, then the smaller own anchor."""
    low, high = (F.col(c) for c in _AXES[axis])
    anchors = objects.select("page", "id", F.explode(F.array(low, (low + high) / 2, high)).alias("at"))
    dealt = _dealt(anchors, reach)
    for side, way in (("below", F.asc), ("above", F.desc)):
        order = Window.partitionBy("page", "cell").orderBy(way("at"), way("id"))
        others = [F.when(F.lag("id", k).over(order) != F.col("id"), F.lag("at", k).over(order)) for k in (1, 2, 3)]
        dealt = dealt.withColumn(side, F.coalesce(*others))
    both = dealt.where("own").select("page", "id", "at", F.explode(F.array("below", "above")).alias("guide")).where("guide IS NOT NULL")
    shift = F.col("guide") - F.col("at")
    near = both.withColumn("shift", shift).where(F.round(F.abs(shift), _DECIMALS) < reach)
    best = near.groupBy("page", "id").agg(F.min(F.struct(F.round(F.abs("shift"), _DECIMALS).alias("d"), "guide", "at", "shift")).alias("b"))
    return best.select("page", "id", "b.guide", "b.shift")


def _page_guide(low: Column, high: Column) -> Column:
    """(guide, shift) of the page's thirds by centre, then of its edges; null if none is near."""
    centre = (low + high) / 2
    near = lambda x: F.round(F.abs(x), _DECIMALS) < GUIDE_REACH
    lines = [(near(centre - g), F.struct(F.lit(g).alias("guide"), (g - centre).alias("shift"))) for g in GUIDES]
    lines += [(near(low), F.struct(F.lit(0.0).alias("guide"), (-low).alias("shift"))), (near(high - 1), F.struct(F.lit(1.0).alias("guide"), (1 - high).alias("shift")))]
    first = F.when(*lines[0])
    return reduce(lambda w, line: w.when(*line), lines[1:], first)


def snapped(objects: DataFrame) -> DataFrame:
    """Objects moved to the nearest anchor of another one, or else to the page's guides, an axis at a time; guide_x and guide_y say to what."""
    out = objects
    for axis, (low, high) in _AXES.items():
        near = nearest_anchors(objects, axis).select("page", "id", F.struct("guide", "shift").alias("_near"))
        out = out.join(near, ["page", "id"], "left").withColumn("_to", F.coalesce("_near", _page_guide(F.col(low), F.col(high))))
        shift = F.coalesce(F.col("_to.shift"), F.lit(0.0))
        out = out.withColumns({low: F.col(low) + shift, high: F.col(high) + shift, f"guide_{axis}": F.col("_to.guide")}).drop("_near", "_to")
    return out


# Queries


def objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as objects; an order is a group, sixteen orders a page."""
    left, top = (F.col("l_partkey") % 83) / 100.0, (F.col("l_suppkey") * 7 % 79) / 100.0
    w, h = F.col("l_quantity") / 400, (F.col("l_linenumber") * 3 + 2) / 200.0
    return read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), F.col("l_orderkey").alias("order"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"), left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))


def _shown(objects: DataFrame, *more: str) -> DataFrame:
    """Rounded just above the half, so that no result hangs on a last bit."""
    return objects.select("id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("left", "top", "right", "bottom", *more)])


def align_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's objects on their common vertical middle and right edge."""
    return _shown(aligned(aligned(objects_of(spark, sf_dir), "vcenter", "order"), "right", "order"))


def distribute_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(distributed(distributed(objects_of(spark, sf_dir), "x", "order"), "y", "order"))


def snap_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(snapped(objects_of(spark, sf_dir)), "guide_x", "guide_y")


QUERIES = {f.__name__: f for f in (align_objects, distribute_objects, snap_objects)}
_OBJECTS = """o AS (SELECT l_orderkey // 16 AS page, l_orderkey AS ord, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS id, (l_partkey % 83) / 100.0::DOUBLE AS l, (l_suppkey * 7 % 79) / 100.0::DOUBLE AS t, (l_partkey % 83) / 100.0::DOUBLE + l_quantity / 400 AS r, (l_suppkey * 7 % 79) / 100.0::DOUBLE + (l_linenumber * 3 + 2) / 200.0::DOUBLE AS b FROM lineitem)"""


def _spread(low: str, high: str) -> str:
    c = f"(({low} + {high}) / 2)"
    return f"""CASE WHEN count(*) OVER w > 2 AND row_number() OVER (PARTITION BY ord ORDER BY {c}, id) NOT IN (1, count(*) OVER w) THEN min({c}) OVER w + (max({c}) OVER w - min({c}) OVER w) / (count(*) OVER w - 1) * (row_number() OVER (PARTITION BY ord ORDER BY {c}, id) - 1) - {c} ELSE 0 END"""


def _snap(axis: str, low: str, high: str) -> str:
    c = f"(({low} + {high}) / 2)"
    guides = " ".join(f"WHEN round(abs({c} - {g}), 9) < 0.014 THEN {{'guide': {g}::DOUBLE, 'shift': {g} - {c}}}" for g in GUIDES)
    return f"""a{axis} AS (SELECT page, id, unnest([{low}, {c}, {high}]) AS at FROM o),
 n{axis} AS (SELECT a.page, a.id, min({{'d': round(abs(b.at - a.at), 9), 'guide': b.at, 'at': a.at, 'shift': b.at - a.at}}) AS n FROM a{axis} a JOIN a{axis} b ON a.page = b.page AND a.id <> b.id AND round(abs(b.at - a.at), 9) < 0.012 GROUP BY a.page, a.id),
 g{axis} AS (SELECT o.id, CASE WHEN n IS NOT NULL THEN {{'guide': n.guide, 'shift': n.shift}} {guides} WHEN round(abs({low}), 9) < 0.014 THEN {{'guide': 0::DOUBLE, 'shift': -{low}}} WHEN round(abs({high} - 1), 9) < 0.014 THEN {{'guide': 1::DOUBLE, 'shift': 1 - {high}}} END AS {axis} FROM o LEFT JOIN n{axis} USING (page, id))"""


_ROUNDED = 'round({} + 1e-9, 6) AS "left", round({} + 1e-9, 6) AS top, round({} + 1e-9, 6) AS "right", round({} + 1e-9, 6) AS bottom'
ORACLE_SQL = {
    "align_objects": f"WITH {_OBJECTS}, g AS (SELECT *, count(*) OVER w AS n, max(r) OVER w - r AS dx, (min(t) OVER w + max(b) OVER w - t - b) / 2 AS dy FROM o WINDOW w AS (PARTITION BY ord)) SELECT id, {_ROUNDED.format('l + dx', 't + dy', 'r + dx', 'b + dy')} FROM g",
    "distribute_objects": f"WITH {_OBJECTS}, g AS (SELECT *, {_spread('l', 'r')} AS dx, {_spread('t', 'b')} AS dy FROM o WINDOW w AS (PARTITION BY ord)) SELECT id, {_ROUNDED.format('l + dx', 't + dy', 'r + dx', 'b + dy')} FROM g",
    "snap_objects": f"WITH {_OBJECTS}, {_snap('x', 'l', 'r')}, {_snap('y', 't', 'b')}, s AS (SELECT o.*, x, y, coalesce(x.shift, 0) AS dx, coalesce(y.shift, 0) AS dy FROM o JOIN gx USING (id) JOIN gy USING (id)) SELECT id, {_ROUNDED.format('l + dx', 't + dy', 'r + dx', 'b + dy')}, round(x.guide + 1e-9, 6) AS guide_x, round(y.guide + 1e-9, 6) AS guide_y FROM s",
}
