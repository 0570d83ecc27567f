"""Saved annotations of eight kinds, read as VARIANT, typed by kind, written back.

A saved layer is ``{"version": 1, "pages": {"0": [annotation, ...]}}``. No schema holds all kinds, so an annotation is
parsed to a VARIANT; a table of fields per kind says what is read from it. A field of another type than it should have,
a missing one without a default, or an unknown kind makes the annotation broken; it is kept apart with its text,
and the others of its page stay. Unknown fields are left out. Colours are numbers (ARGB). Form fields saved in the former
default colours get the present ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read

# The former and present colours of form fields, and the names that an annotation may use, the default first.
FORMER_BORDER, FORMER_FILL, BORDER, FILL = 0xFF2563EB, 0x1A2563EB, 0xFFB9C0CF, 0xFFFFFFFF
NAMES = {
    "shapeType": ("rect", "line", "arrow", "oval", "whiteout", "link", "measure"),
    "markup": ("highlight", "underline", "strikeout", "squiggly"),
    "note": ("yellow", "blue", "green", "pink", "orange"),
    "stamp": ("custom", "approved", "rejected", "confidential", "draft", "finalVersion", "paid", "voided", "urgent", "copy"),
    "field": ("text", "number", "date", "email", "phone", "name", "signature", "checkbox", "radio", "combobox"),
    "textAlign": ("left", "right", "center", "justify", "start", "end"),
}

_MUST = object()
_POINTS, _RUNS = "array<array<double>>", "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,color:bigint,fontFamily:string,sizeScale:double>>"
#: Kind -> fields as (name, type, default); _MUST has none, None may be missing.
FIELDS: dict[str, tuple[tuple, ...]] = {
    "stroke": (("points", _POINTS, _MUST), ("breaks", "array<int>", ()), ("color", "bigint", _MUST), ("width", "double", _MUST), ("highlight", "boolean", False)),
    "shape": (("shapeType", "shapeType", "rect"), ("startX", "double", _MUST), ("startY", "double", _MUST), ("endX", "double", _MUST), ("endY", "double", _MUST), ("color", "bigint", _MUST), ("width", "double", _MUST), ("filled", "boolean", False)),
    "text": (("posX", "double", _MUST), ("posY", "double", _MUST), ("text", "string", ""), ("color", "bigint", 0xFF000000), ("size", "double", _MUST), ("bold", "boolean", False), ("italic", "boolean", False), ("underline", "boolean", False), ("fontFamily", "string", None), ("textAlign", "textAlign", "left"), ("textDirection", "string", None), ("lineHeight", "double", 1.0), ("charSpacing", "double", 0.0), ("width", "double", None), ("height", "double", None), ("rotation", "double", 0.0), ("runs", _RUNS, None)),
    "image": (("posX", "double", _MUST), ("posY", "double", _MUST), ("width", "double", _MUST), ("height", "double", _MUST), ("rotation", "double", 0.0), ("label", "string", "Image"), ("bytes", "string", _MUST)),
    "stamp": (("posX", "double", _MUST), ("posY", "double", _MUST), ("width", "double", _MUST), ("height", "double", _MUST), ("kind", "stamp", "custom"), ("customText", "string", ""), ("color", "bigint", 0xFF000000), ("rotation", "double", 0.0)),
    "markup": (("kind", "markup", "highlight"), ("color", "bigint", 0xFFFFEB3B), ("text", "string", ""), ("rects", _POINTS, ())),
    "note": (("posX", "double", 0.1), ("posY", "double", 0.1), ("text", "string", ""), ("color", "note", "yellow"), ("author", "string", ""), ("createdAt", "string", None)),
    "field": (("posX", "double", _MUST), ("posY", "double", _MUST), ("width", "double", _MUST), ("height", "double", _MUST), ("kind", "field", "text"), ("label", "string", ""), ("value", "string", ""), ("required", "boolean", False), ("checked", "boolean", False), ("options", "array<string>", ()), ("multiline", "boolean", False), ("borderColor", "bigint", BORDER), ("fillColor", "bigint", FILL), ("fontSize", "double", 0.018)),
}
#: Of every kind.
BASE = (("id", "string", None), ("opacity", "double", 1.0), ("locked", "boolean", False), ("visible", "boolean", True), ("zIndex", "double", 0.0))
_SAID = {"double": "^(BIGINT|DOUBLE|DECIMAL)", "bigint": "^BIGINT", "string": "^STRING", "boolean": "^BOOLEAN"}


def _sql_type(kind: str) -> str:
    return "string" if kind in NAMES else kind


def _field(v: Column, name: str, kind: str, default) -> tuple[Column, Column]:
    """(value, whether it is good) of a field."""
    path = f"$.{name}"
    said = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    missing = said.isNull() | (said == "VOID")
    value = F.try_variant_get(v, path, _sql_type(kind))
    fits = said.rlike(_SAID.get(_sql_type(kind), "^ARRAY"))
    if kind == _POINTS:
        least = 2 if name == "points" else 4
        whole = lambda p: (F.size(p) >= least) & F.forall(F.slice(p, 1, least), lambda x: x.isNotNull())
        # A stroke with a bad point is broken; a bad rectangle is left out.
        fits = fits & value.isNotNull() & (F.forall(value, lambda p: p.isNotNull() & whole(p)) if name == "points" else F.lit(True))
        value = F.transform(F.filter(value, lambda p: p.isNotNull() & whole(p)), lambda p: F.slice(p, 1, least))
    if kind in NAMES:
        value = F.when(value.isin(*NAMES[kind]), value).otherwise(NAMES[kind][0])
    if name == "bytes":
        fits = fits & F.try_to_binary(value, F.lit("base64")).isNotNull()
    if default is _MUST:
        return value, F.coalesce(fits, F.lit(False))
    if name == "borderColor":
        value = F.when(value == FORMER_BORDER, BORDER).otherwise(value)
    if name == "fillColor":
        value = F.when(value == FORMER_FILL, FILL).otherwise(value)
    other = F.array().cast(_sql_type(kind)) if default == () else F.lit(default).cast(_sql_type(kind))
    # Loose ends that the format allows: a list of other things is no list, and no reason to break.
    loose = kind.startswith("array") and name != "breaks"
    return F.coalesce(value, other), F.lit(True) if loose else F.coalesce(missing | fits, F.lit(False))


def annotation(v: Column) -> Column:
    """Struct of a VARIANT: type, the base fields, metadata (JSON), and a struct for each kind of which only the annotation's own is set; null if broken."""
    kind = F.try_variant_get(v, "$.type", "string")
    bodies, good = [], F.lit(False)
    for name, fields in FIELDS.items():
        values = [(f[0], *_field(v, *f)) for f in fields]
        sound = kind == name
        for _, _, ok in values:
            sound = sound & ok
        body = F.struct(*[x.alias(n) for n, x, _ in values])
        if name == "stroke":
            n = F.size(body["points"])
            body = F.struct(*[(F.filter(x, lambda b: (b > 0) & (b < n)) if f == "breaks" else x).alias(f) for f, x, _ in values])
        bodies.append(F.when(sound, body).alias(name))
        good = good | F.coalesce(sound, F.lit(False))
    base = [(f[0], *_field(v, *f)) for f in BASE]
    for _, _, ok in base:
        good = good & ok
    meta = F.try_variant_get(v, "$.metadata", "variant")
    metadata = F.when(F.schema_of_variant(meta).startswith("OBJECT"), F.to_json(meta))
    return F.when(good, F.struct(kind.alias("type"), *[(x.cast("int") if n == "zIndex" else x).alias(n) for n, x, _ in base], metadata.alias("metadata"), *bodies))


def annotation_json(a: Column) -> Column:
    """The annotation as saved JSON; reading it back gives the same annotation."""
    base = [a[n].alias(n) for n in ("type", "id", "opacity", "locked", "visible", "zIndex")]
    whole = F.lit(None).cast("string")
    for name, fields in FIELDS.items():
        body = F.to_json(F.struct(*base, F.try_parse_json(a["metadata"]).alias("metadata"), *[a[name][f[0]].alias(f[0]) for f in fields]))
        whole = F.when(a["type"] == name, body).otherwise(whole)
    return whole


def layer_annotations(layers: DataFrame, id_col: str = "doc", json_col: str = "layers") -> DataFrame:
    """(id, page, place, annotation, broken): every annotation of saved layers; ``broken`` is the JSON of one that cannot be read."""
    pages = F.try_variant_get(F.try_parse_json(F.col(json_col)), "$.pages", "map<string,variant>")
    each = layers.select(id_col, F.explode(pages).alias("page", "v")).select(id_col, F.col("page").try_cast("int").alias("page"), F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("place", "v"))
    found = each.where("page IS NOT NULL").withColumn("annotation", annotation(F.col("v")))
    return found.select(id_col, "page", "place", "annotation", F.when(F.col("annotation").isNull(), F.to_json("v")).alias("broken"))


def saved_layers(annotations: DataFrame, id_col: str = "doc") -> DataFrame:
    """(id, layers): annotations (id, page, place, annotation) as saved layers, pages without any left out."""
    item = F.struct("place", annotation_json(F.col("annotation")).alias("j"))
    of_page = annotations.where("annotation IS NOT NULL").groupBy(id_col, "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = F.concat(F.lit('"'), F.col("page").cast("string"), F.lit('":['), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]"))
    whole = of_page.select(id_col, F.struct("page", text.alias("t")).alias("p")).groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(id_col, F.concat(F.lit('{"version":1,"pages":{'), F.array_join(F.transform("p", lambda x: x["t"]), ","), F.lit("}}")).alias("layers"))


# Queries


#: An event's annotation; in SQL that both engines read. Every ninth is of no kind, every eleventh has a wrong type.
_COMMON = "concat(', \"id\": \"a', CAST(event_id AS STRING), '\"', CASE WHEN event_id % 4 = 0 THEN ', \"opacity\": 0.5, \"zIndex\": 3' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN ', \"metadata\": {\"k\": 1}' ELSE '' END, CASE WHEN event_id % 11 = 0 THEN ', \"locked\": \"yes\"' ELSE '' END, '}')"
_PLACE = "\"posX\": 0.', CAST(event_id % 90 + 10 AS STRING), ', \"posY\": 0.25"
_BODIES = (
    "'{\"type\": \"stroke\", \"points\": [[0.1, 0.2], [0.3, 0.4, 9]], \"breaks\": [0, 1, 2], \"color\": 4278190080, \"width\": 1.5'",
    "'{\"type\": \"shape\", \"shapeType\": \"', CASE WHEN event_id % 2 = 0 THEN 'oval' ELSE 'star' END, '\", \"startX\": 0, \"startY\": 0.1, \"endX\": 1, \"endY\": 0.5, \"color\": 255, \"width\": 2'",
    "'{\"type\": \"text\", {P}, \"text\": \"', event_type, '\", \"size\": 0.0', CAST(event_id % 9 + 1 AS STRING)",
    "'{\"type\": \"image\", {P}, \"width\": 0.2, \"height\": 0.1, \"bytes\": \"', CASE WHEN event_id % 2 = 0 THEN 'aGk=' ELSE '***' END, '\"'",
    "'{\"type\": \"stamp\", {P}, \"width\": 0.2, \"height\": 0.1, \"kind\": \"', CASE WHEN event_id % 2 = 0 THEN 'paid' ELSE 'odd' END, '\"'",
    "'{\"type\": \"markup\", \"kind\": \"underline\", \"rects\": [[0, 0, 1, 1], [1, 2], \"x\"]'",
    "'{\"type\": \"note\", \"text\": \"', event_type, '\", \"color\": \"pink\"'",
    "'{\"type\": \"field\", {P}, \"width\": 0.3, \"height\": 0.05, \"kind\": \"date\", \"borderColor\": 4280640491, \"fillColor\": ', CASE WHEN event_id % 2 = 0 THEN '438658027' ELSE '7' END, ', \"options\": [\"a\"]'",
    "'{\"type\": \"cloud\"'",
)
_EVENT_JSON = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN concat({b.replace('{P}', _PLACE)}, {_COMMON})" for i, b in enumerate(_BODIES)) + " END"


def _event_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as annotations, ten pages a user."""
    one = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc"), (F.col("event_id") % 10).alias("page"), F.expr(_EVENT_JSON).alias("j"))
    of_page = one.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("event_id", "j"))).alias("x"))
    text = F.concat(F.lit('"'), F.col("page").cast("string"), F.lit('": ['), F.array_join(F.transform("x", lambda e: e["j"]), ", "), F.lit("]"))
    return of_page.select("doc", text.alias("t")).groupBy("doc").agg(F.concat(F.lit('{"version": 1, "pages": {'), F.array_join(F.array_sort(F.collect_list("t")), ", "), F.lit("}}")).alias("layers"))


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written, read back and read again: what each kind holds."""
    layers = _event_layers(spark, sf_dir)
    once = layer_annotations(layers).where("annotation IS NOT NULL")
    back = layer_annotations(saved_layers(once))
    a = F.col("annotation")
    said = F.coalesce(F.array_join(F.transform(a["stroke"]["breaks"], lambda b: b.cast("string")), ","), a["shape"]["shapeType"], a["text"]["text"], a["image"]["label"], a["stamp"]["kind"], F.size(a["markup"]["rects"]).cast("string"), a["note"]["color"], a["field"]["fillColor"].cast("string"))
    x = F.coalesce(a["text"]["posX"], a["image"]["posX"], a["stamp"]["posX"], a["note"]["posX"], a["field"]["posX"])
    return back.select("doc", a["id"].alias("id"), a["type"].alias("type"), "page", "place", x.alias("x"), a["opacity"].alias("opacity"), a["zIndex"].alias("z"), a["metadata"].alias("metadata"), said.alias("said"), a["field"]["borderColor"].alias("border"))


def broken_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layer_annotations(_event_layers(spark, sf_dir)).where("broken IS NOT NULL")
    return found.select("doc", "page", F.get_json_object("broken", "$.id").alias("id"), F.get_json_object("broken", "$.type").alias("type"))


QUERIES = {f.__name__: f for f in (annotation_rows, broken_annotations)}
_GOOD = "event_id % 9 <> 8 AND event_id % 11 <> 0 AND NOT (event_id % 9 = 3 AND event_id % 2 = 1)"
ORACLE_SQL = {
    "annotation_rows": f"""SELECT user_id AS doc, 'a' || event_id AS id, ['stroke', 'shape', 'text', 'image', 'stamp', 'markup', 'note', 'field'][event_id % 9 + 1] AS type, CAST(event_id % 10 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id) - 1 AS INTEGER) AS place,
 CASE WHEN event_id % 9 IN (2, 3, 4, 7) THEN (event_id % 90 + 10) / 100 WHEN event_id % 9 = 6 THEN 0.1::DOUBLE END AS x, CAST(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 1 END AS DOUBLE) AS opacity, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS z, CASE WHEN event_id % 5 = 0 THEN '{{"k":1}}' END AS metadata,
 CASE event_id % 9 WHEN 0 THEN '1' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'oval' ELSE 'rect' END WHEN 2 THEN event_type WHEN 3 THEN 'Image' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'paid' ELSE 'custom' END WHEN 5 THEN '1' WHEN 6 THEN 'pink' ELSE CASE WHEN event_id % 2 = 0 THEN '{FILL}' ELSE '7' END END AS said,
 CASE WHEN event_id % 9 = 7 THEN {BORDER} END AS border FROM events WHERE {_GOOD}""",
    "broken_annotations": f"SELECT user_id AS doc, CAST(event_id % 10 AS INTEGER) AS page, 'a' || event_id AS id, CASE event_id % 9 WHEN 8 THEN 'cloud' ELSE ['stroke', 'shape', 'text', 'image', 'stamp', 'markup', 'note', 'field'][event_id % 9 + 1] END AS type FROM events WHERE NOT ({_GOOD})",
}
