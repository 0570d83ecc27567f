import json

from pyspark.sql import functions as F

from paperloom.operators import annotations

GOOD = [
    {"type": "stroke", "id": "s", "points": [[0.1, 0.2], [0.3, 0.4], [0.5, 1]], "breaks": [0, 2, 9], "color": 4278190080, "width": 2, "highlight": True},
    {"type": "shape", "shapeType": "nonsense", "startX": 0, "startY": 0.5, "endX": 1, "endY": 1, "color": 1, "width": 0.5, "opacity": 0.25, "zIndex": 2.0},
    {"type": "text", "posX": 0.1, "posY": 0.2, "size": 0.02, "text": 'a "b" \n ü🙂', "fontFamily": None, "runs": [{"text": "x", "bold": True}], "textAlign": "center", "unknown": 1},
    {"type": "image", "posX": 0.1, "posY": 0.2, "width": 1, "height": 1, "bytes": "aGVsbG8=", "metadata": {"a": [1, {"b": None}]}},
    {"type": "stamp", "posX": 0.1, "posY": 0.2, "width": 1, "height": 1, "kind": "urgent", "locked": True, "visible": False},
    {"type": "markup", "rects": [[0, 0, 1, 1, 5], [1], "x"], "kind": 7 and "squiggly"},
    {"type": "note"},
    {"type": "field", "posX": 0.1, "posY": 0.2, "width": 1, "height": 1, "borderColor": annotations.FORMER_BORDER, "options": ["a", "b"], "kind": "radio"},
]
BAD = [{"type": "cloud"}, {}, 5, "x", None, [1], {"type": "stroke", "color": 1, "width": 1}, {"type": "stroke", "points": [[1]], "color": 1, "width": 1}, {"type": "text", "posX": "0.1", "posY": 0, "size": 1}, {"type": "note", "text": 5}, {"type": "note", "locked": "yes"}, {"type": "image", "posX": 0, "posY": 0, "width": 1, "height": 1, "bytes": "*"}, {"type": "shape", "startX": 0, "startY": 0.5, "endX": 1, "endY": 1, "color": 1.5, "width": 0.5}]


def layers(spark, rows):
    return spark.createDataFrame([(i, x, "page") for i, x in enumerate(rows)], "doc long, layers string, page string")


def test_kinds_defaults_and_broken_rows(spark):
    text = json.dumps({"version": 1, "pages": {"0": GOOD, "12": BAD, "x": GOOD, "3": "no list"}})
    rows = annotations.layer_annotations(layers(spark, [text, "broken", None, "{}", "[]"])).collect()
    good = sorted((r for r in rows if r["annotation"]), key=lambda r: r["place"])
    assert [r["annotation"]["type"] for r in good] == [g["type"] for g in GOOD] and {r["page"] for r in good} == {0}
    assert len([r for r in rows if r["broken"]]) == len(BAD) == len(rows) - len(GOOD)
    a = [r["annotation"] for r in good]
    assert a[0]["stroke"]["breaks"] == [2] and a[0]["stroke"]["points"][2] == [0.5, 1.0]
    assert a[1]["shape"]["shapeType"] == "rect" and (a[1]["opacity"], a[1]["zIndex"]) == (0.25, 2)
    assert a[2]["text"]["text"] == 'a "b" \n ü🙂' and a[2]["text"]["runs"][0]["bold"] and a[2]["text"]["color"] == 0xFF000000
    assert json.loads(a[3]["metadata"]) == {"a": [1, {"b": None}]}
    assert (a[4]["locked"], a[4]["visible"], a[4]["stamp"]["kind"]) == (True, False, "urgent")
    assert a[5]["markup"]["rects"] == [[0, 0, 1, 1]] and a[6]["note"]["color"] == "yellow" and a[6]["note"]["posX"] == 0.1
    assert a[7]["field"]["borderColor"] == annotations.BORDER and a[7]["field"]["fillColor"] == annotations.FILL
    assert all(sum(x[k] is not None for k in annotations.FIELDS) == 1 for x in a)


def test_written_and_read_back_are_equal(spark):
    df = layers(spark, [json.dumps({"version": 1, "pages": {"0": GOOD[:4], "5": GOOD[4:]}}), json.dumps({"pages": {"1": GOOD + BAD}}), "{}"])
    once = annotations.layer_annotations(df).where("annotation IS NOT NULL")
    saved = annotations.saved_layers(once)
    assert saved.count() == 2 and all(json.loads(r["layers"])["version"] == 1 for r in saved.collect())
    show = lambda d: sorted(map(str, d.select("doc", "page", "place", F.to_json("annotation")).collect()))
    assert show(annotations.layer_annotations(saved)) == show(once)
