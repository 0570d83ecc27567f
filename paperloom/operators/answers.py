"""What is done with a model's answers: JSON salvage, repair of edit lists and filled fields. The model itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, values_and
from paperloom.sources.tables import read

CATEGORIES = ("grammar", "clarity", "tone", "spelling", "other")
MAX_EDITS = 100


def _is_json(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def salvaged_json(answer: Column) -> Column:
    """The JSON text in an answer: the whole, else a fenced block, else from the first brace to the last; null if none parses."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    candidates = F.filter(F.array(F.trim(answer), F.trim(fenced), braces), lambda x: (x != "") & _is_json(x))
    return F.get(candidates, F.lit(0))


def edit_list(answer: Column) -> Column:
    """Array of (original, suggestion, reason, category) from ``{"edits": [...]}``, ``{"suggestions": [...]}`` or a bare list; pairs without a change go."""
    items = F.coalesce(F.get_json_object(answer, "$.edits"), F.get_json_object(answer, "$.suggestions"), answer)
    raw = F.slice(F.coalesce(F.from_json(items, "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), 1, MAX_EDITS)

    def text(e: Column, *names: str) -> Column:
        return F.trim(F.coalesce(*[e[n] for n in names], F.lit("")))

    def repaired(e: Column) -> Column:
        category = F.lower(text(e, "category"))
        return F.struct(
            text(e, "original", "from").alias("original"),
            text(e, "suggestion", "to", "replacement").alias("suggestion"),
            F.substring(text(e, "reason"), 1, 200).alias("reason"),
            F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"),
        )

    return F.filter(F.transform(raw, repaired), lambda e: (e["original"] != "") & (e["suggestion"] != "") & (e["original"] != e["suggestion"]))


def filled_field(answer: Column) -> Column:
    """Struct of a filled field from tolerant JSON: alias names, percent to share, off checkboxes and empty texts are null."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(answer, f"$.{n}") for n in names])

    kind = F.lower(F.trim(F.coalesce(first("type"), F.lit(""))))
    kind = F.when(kind.isin("check", "checkbox", "tick", "radio"), "check").when(kind.isin("signature", "sign", "sig"), "signature").otherwise("text")
    text = F.trim(F.coalesce(first("text", "value"), F.lit("")))
    off = (kind == "check") & F.lower(text).isin("no", "false", "off", "unchecked", "none")
    text = F.when(kind == "check", "X").otherwise(text)

    def place(name: str) -> Column:
        v = F.coalesce(F.trim(first(name)).try_cast("double"), F.lit(0.15))
        v = F.when(v > 1, v / 100).otherwise(v)
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(0.97)).alias(name)

    confidence = first("confidence")
    unsure = F.coalesce(first("uncertain") == "true", F.lit(False)) | F.coalesce(confidence.try_cast("double") < 0.5, F.lower(F.trim(confidence)).isin("low", "uncertain", "guess", "unsure"), F.lit(False))
    page = F.greatest(F.coalesce(F.trim(first("page")).try_cast("double").cast("int"), F.lit(1)), F.lit(1))
    field = F.struct(page.alias("page"), place("x"), place("y"), text.alias("text"), F.trim(F.coalesce(first("field", "label", "name"), F.lit(""))).alias("field"), kind.alias("type"), unsure.alias("uncertain"))
    return F.when(~off & (text != "") & answer.startswith("{"), field)


ANSWERS = [(0, '{"a": 1}'), (1, 'Here you are:\n```json\n{"a": 2}\n```\nbye'), (2, 'so {"a": {"b": 3}} it is'), (3, "no json"), (4, '{"a": '), (5, "```\n[1, 2]\n```")]
EDITS = [(0, '{"edits": [{"original": "colour", "suggestion": "color", "category": "Spelling"}, {"original": "", "suggestion": "x"}, {"original": "a", "suggestion": "a"}]}'), (1, '[{"from": " teh ", "to": "the", "reason": "typo", "category": "odd"}]'), (2, '{"suggestions": [{"original": "u", "replacement": "you", "category": "tone"}]}'), (3, "nothing"), (4, '{"edits": [{"original": "gone"}]}')]
FIELDS = [(0, '{"type": "checkbox", "value": "yes", "x": 50, "y": 99, "page": 0}'), (1, '{"type": "radio", "text": "Off"}'), (2, '{"text": " Ann ", "label": "Name", "x": "0.3", "confidence": 0.4, "page": "2"}'), (3, '{"value": "", "field": "x"}'), (4, '{"type": "sig", "text": "s", "confidence": "low", "y": -3}'), (5, '[1]'), (6, '{"text": "t", "uncertain": true, "confidence": 0.9}')]


def _answers(spark: SparkSession, sf_dir: str, literal: list[tuple], forms: list[str]) -> DataFrame:
    """Literal answers, and one for each event, in one of the given forms (SQL that both engines read)."""
    form = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms))
    own = read(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.expr(f"CASE event_id % {len(forms)} {form} END").alias("answer"))
    return frame(spark, literal, "id long, answer string").unionByName(own)


def _answers_sql(literal: list[tuple], forms: list[str]) -> str:
    form = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms))
    return values_and(literal, "id, answer", "a", f"SELECT event_id + 1000, CASE event_id % {len(forms)} {form} END FROM events")


_ANSWER_FORMS = ["props", "concat('Here:', chr(10), '```json', chr(10), props, chr(10), '```')", "concat('so ', props, ' it is')", "substring(props, 1, length(props) - 1)", "event_type", "concat('{', props, '} or ', props)"]
_PAIR = """concat('{"original": "', event_type, '", "suggestion": "', replace(event_type, 'c', 'k'), '", "reason": " no. ', CAST(event_id AS STRING), ' ", "category": "', CASE event_id % 3 WHEN 0 THEN 'Tone' WHEN 1 THEN 'odd' ELSE ' clarity ' END, '"}')"""
_EDIT_FORMS = [f"concat('{{\"edits\": [', {_PAIR}, ', {{\"original\": \"\", \"suggestion\": \"x\"}}]}}')", f"concat('[', {_PAIR}, ', {{\"from\": \" teh \", \"to\": \"', event_type, '\"}}]')", f"concat('{{\"suggestions\": [', {_PAIR}, ']}}')", "event_type", f"concat('{{\"edits\": [', {_PAIR})"]
_FIELD = """concat('{"type": "', CASE event_id % 4 WHEN 0 THEN 'Check' WHEN 1 THEN 'sign' WHEN 2 THEN 'radio' ELSE 'x' END, '", "value": "', CASE WHEN event_id % 3 = 0 THEN 'off' ELSE event_type END, '", "x": ', CAST(event_id % 130 - 5 AS STRING), ', "page": "', CAST(event_id % 5 - 1 AS STRING), '"'"""
_FIELD_FORMS = [f"{_FIELD}, '}}')", f"{_FIELD}, ', \"confidence\": 0.', CAST(event_id % 10 AS STRING), ', \"label\": \" f \"}}')", f"{_FIELD}, ', \"uncertain\": true, \"text\": \" t \"}}')", "event_type"]


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir, ANSWERS, _ANSWER_FORMS)
    return rows.select("id", salvaged_json(F.col("answer")).alias("json"))


def edit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, EDITS, _EDIT_FORMS).select("id", F.posexplode(edit_list(F.col("answer"))).alias("place", "e")).select("id", F.col("place").cast("long").alias("place"), "e.*")


def filled_field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, FIELDS, _FIELD_FORMS).select("id", filled_field(F.col("answer")).alias("f")).where("f IS NOT NULL").select("id", "f.*")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant read of a JSON column: every third row is cut short and gives null."""
    props = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    k = F.when(_is_json(props), F.get_json_object(props, "$.k").cast("long"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("good"), F.count_if(F.col("k").isNull()).alias("salvaged_out"), F.sum("k").alias("k_sum"))


QUERIES = {f.__name__: f for f in (json_salvage, edit_repair, filled_field_parse, event_props)}
_T = "trim(coalesce({}, ''))"
ORACLE_SQL = {
    "json_salvage": f"SELECT CAST(id AS BIGINT) AS id, list_filter([trim(answer), trim(regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1)), regexp_extract(answer, '(?s)(\\{{.*\\}})', 1)], lambda x: x <> '' AND json_valid(x))[1] AS json FROM {_answers_sql(ANSWERS, _ANSWER_FORMS)}",
    "edit_repair": f"""WITH l AS (SELECT id, CASE WHEN json_valid(answer) THEN coalesce(json_extract(answer, '$.edits'), json_extract(answer, '$.suggestions'), CAST(answer AS JSON)) END AS j FROM {_answers_sql(EDITS, _EDIT_FORMS)}), e AS (SELECT id, k, json_extract(j, '$[' || k || ']') AS x FROM (SELECT id, j, unnest(range(0, CAST(json_array_length(j) AS BIGINT))) AS k FROM l)),
 f AS (SELECT id, k, trim(coalesce(x->>'original', x->>'from', '')) AS original, trim(coalesce(x->>'suggestion', x->>'to', x->>'replacement', '')) AS suggestion, left(trim(coalesce(x->>'reason', '')), 200) AS reason, lower(trim(coalesce(x->>'category', ''))) AS c FROM e)
 SELECT CAST(id AS BIGINT) AS id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS place, original, suggestion, reason, CASE WHEN c IN {CATEGORIES} THEN c ELSE 'other' END AS category FROM f WHERE original <> '' AND suggestion <> '' AND original <> suggestion""",
    "filled_field_parse": f"""WITH j AS (SELECT id, answer, lower(trim(coalesce(answer->>'$.type', ''))) AS k, trim(coalesce(answer->>'$.text', answer->>'$.value', '')) AS t, TRY_CAST(trim(answer->>'$.x') AS DOUBLE) AS x, TRY_CAST(trim(answer->>'$.y') AS DOUBLE) AS y FROM (SELECT id, CAST(answer AS JSON) AS answer FROM {_answers_sql(FIELDS, _FIELD_FORMS)} WHERE answer LIKE '{{%')),
 n AS (SELECT *, CASE WHEN k IN ('check', 'checkbox', 'tick', 'radio') THEN 'check' WHEN k IN ('signature', 'sign', 'sig') THEN 'signature' ELSE 'text' END AS type FROM j)
 SELECT CAST(id AS BIGINT) AS id, greatest(coalesce(CAST(TRY_CAST(trim(answer->>'$.page') AS DOUBLE) AS INTEGER), 1), 1) AS page, least(greatest(CASE WHEN coalesce(x, 0.15) > 1 THEN x / 100 ELSE coalesce(x, 0.15::DOUBLE) END, 0), 0.97::DOUBLE) AS x, least(greatest(CASE WHEN coalesce(y, 0.15) > 1 THEN y / 100 ELSE coalesce(y, 0.15::DOUBLE) END, 0), 0.97::DOUBLE) AS y,
 CASE WHEN type = 'check' THEN 'X' ELSE t END AS text, trim(coalesce(answer->>'$.field', answer->>'$.label', answer->>'$.name', '')) AS field, type, coalesce(answer->>'$.uncertain' = 'true', false) OR coalesce(TRY_CAST(answer->>'$.confidence' AS DOUBLE) < 0.5, lower(trim(answer->>'$.confidence')) IN ('low', 'uncertain', 'guess', 'unsure'), false) AS uncertain
 FROM n WHERE NOT (type = 'check' AND lower(t) IN ('no', 'false', 'off', 'unchecked', 'none')) AND (type = 'check' OR t <> '')""",
    "event_props": "WITH p AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) ELSE props END AS p FROM events), k AS (SELECT event_type, CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k FROM p) SELECT event_type, count(k) AS good, count(*) - count(k) AS salvaged_out, CAST(sum(k) AS BIGINT) AS k_sum FROM k GROUP BY event_type",
}
