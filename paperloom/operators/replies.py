"""Repair of a model's classification of form fields: malformed entries dropped, texts capped, confidence mended, labels it left out added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import forms
from paperloom.sources.tables import read

ENTRY = ("label", "semantic_type", "profile_key", "field_type", "confidence", "reason")


def _entries(reply: Column) -> Column:
    """The JSON objects under ``fields``; anything else in the list is dropped."""
    items = F.from_json(F.get_json_object(reply, "$.fields"), "array<string>")
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda e: F.coalesce(e.startswith("{"), F.lit(False)))


def _entry(**columns: Column) -> Column:
    return F.struct(*[columns[c].cast("double" if c == "confidence" else "string").alias(c) for c in ENTRY])


def _with_missing(found: Column, asked: Column, default) -> Column:
    """The found entries and a default one for each label asked for (struct of label and type) that none of them has."""
    labels = F.transform(found, lambda e: e["label"])
    return F.concat(found, F.transform(F.filter(asked, lambda a: ~F.array_contains(labels, a["label"])), default))


def classified(reply: Column, asked: Column) -> Column:
    """Every labelled entry, whatever was asked for: texts capped at 100, 50 and 300 characters, confidence 0.5 where there is none and null where it is no number."""

    def said(e: Column, *names: str) -> Column:
        return F.coalesce(*[F.get_json_object(e, f"$.{n}") for n in names])

    def entry(e: Column) -> Column:
        sure = F.coalesce(said(e, "confidence"), F.lit("0.5")).try_cast("double")
        return _entry(
            label=said(e, "label"),
            semantic_type=F.substring(F.coalesce(said(e, "semantic_type"), F.lit("unknown")), 1, 100),
            profile_key=F.substring(F.coalesce(said(e, "profile_key", "semantic_type"), F.lit("unknown")), 1, 100),
            field_type=F.substring(F.coalesce(said(e, "field_type"), F.lit("text")), 1, 50),
            confidence=sure,
            reason=F.substring(F.coalesce(said(e, "reasoning"), F.lit("")), 1, 300),
        )

    found = F.filter(F.transform(_entries(reply), entry), lambda e: F.coalesce(e["label"], F.lit("")) != "")
    return _with_missing(found, asked, lambda a: _entry(label=a["label"], semantic_type=F.lit("unknown"), profile_key=F.lit("unknown"), field_type=a["type"], confidence=F.lit(0.0), reason=F.lit("Not classified by AI")))


def checked(reply: Column, asked: Column) -> Column:
    """The entries of labels that were asked for: confidence within 0 and 1, and 0 where it is no number."""
    labels = F.transform(asked, lambda a: a["label"])

    def entry(e: Column) -> Column:
        said = lambda n: F.coalesce(F.get_json_object(e, f"$.{n}"), F.lit(""))
        sure = F.coalesce(said("confidence").try_cast("double"), F.lit(0.0))
        return _entry(label=said("label"), semantic_type=F.coalesce(F.nullif(said("semantic_type"), F.lit("")), F.lit("other")), profile_key=said("profile_key"), field_type=F.lit(None), confidence=F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)), reason=said("reason"))

    found = F.filter(F.transform(_entries(reply), entry), lambda e: F.array_contains(labels, e["label"]))
    return _with_missing(found, asked, lambda a: _entry(label=a["label"], semantic_type=F.lit("other"), profile_key=F.lit(""), field_type=F.lit(None), confidence=F.lit(0.0), reason=F.lit("Model did not return a classification for this field.")))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests for three labels, with replies in all states of repair."""
    k = F.col("c_custkey")
    entries = [
        (k % 7 != 0, F.lit('{"label":"Name","semantic_type":"name","profile_key":"full_name","confidence":0.9,"reasoning":"as said","reason":"ok"}')),
        (k % 2 == 0, F.lit('{"label":"Mail","confidence":"high","semantic_type":""}')),
        (k % 3 == 0, F.lit('"oops"')),
        (k % 5 == 0, F.lit('{"label":"Ghost","semantic_type":"x","confidence":2,"field_type":"date"}')),
        (k % 4 == 0, F.lit('{"semantic_type":"no label"}')),
    ]
    body = F.concat(F.lit('{"fields":['), F.concat_ws(",", *[F.when(c, v) for c, v in entries]), F.lit("]}"))
    asked = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("type")) for a, b in (("Name", "text"), ("Mail", "email"), ("Date", "date"))])
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 == 0, "no json").otherwise(body).alias("reply"), asked.alias("asked"))


def classified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("c_custkey", F.explode(classified(F.col("reply"), F.col("asked"))).alias("e")).select("c_custkey", "e.*")


def checked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("c_custkey", F.explode(checked(F.col("reply"), F.col("asked"))).alias("e")).select("c_custkey", "e.*").drop("field_type")


def forms_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as the fields of a form: whether all are valid."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("number", "name", "zip"))), (k % 3).cast("int"))
    value = F.get(F.array(k.cast("string"), F.concat(F.lit("N"), F.when(k % 8 == 1, "1").otherwise("n")), F.substring("o_orderpriority", 1, 1)), (k % 3).cast("int"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("form"), forms.validation(value, kind).alias("c"))
    return rows.groupBy("form").agg(F.bool_and(F.col("c.error").isNull()).alias("all_valid"), F.count("c.error").alias("errors"))


QUERIES = {f.__name__: f for f in (classified_fields, checked_fields, forms_valid)}

_K = "(SELECT c_custkey, c_custkey % 11 = 0 AS bad, c_custkey AS k FROM customer)"
_NAME, _MAIL, _GHOST = "NOT bad AND k % 7 <> 0", "NOT bad AND k % 2 = 0", "NOT bad AND k % 5 = 0"
ORACLE_SQL = {
    "classified_fields": f"""SELECT c_custkey, 'Name' AS label, 'name' AS semantic_type, 'full_name' AS profile_key, 'text' AS field_type, 0.9::DOUBLE AS confidence, 'as said' AS reason FROM {_K} WHERE {_NAME}
 UNION ALL SELECT c_custkey, 'Mail', '', '', 'text', NULL, '' FROM {_K} WHERE {_MAIL} UNION ALL SELECT c_custkey, 'Ghost', 'x', 'x', 'date', 2.0, '' FROM {_K} WHERE {_GHOST}
 UNION ALL SELECT c_custkey, l, 'unknown', 'unknown', t, 0.0, 'Not classified by AI' FROM {_K}, (VALUES ('Name', 'text'), ('Mail', 'email'), ('Date', 'date')) v(l, t) WHERE l = 'Date' OR (l = 'Name' AND NOT ({_NAME})) OR (l = 'Mail' AND NOT ({_MAIL}))""",
    "checked_fields": f"""SELECT c_custkey, 'Name' AS label, 'name' AS semantic_type, 'full_name' AS profile_key, 0.9::DOUBLE AS confidence, 'ok' AS reason FROM {_K} WHERE {_NAME} UNION ALL SELECT c_custkey, 'Mail', 'other', '', 0.0, '' FROM {_K} WHERE {_MAIL}
 UNION ALL SELECT c_custkey, l, 'other', '', 0.0, 'Model did not return a classification for this field.' FROM {_K}, (VALUES ('Name'), ('Mail'), ('Date')) v(l) WHERE l = 'Date' OR (l = 'Name' AND NOT ({_NAME})) OR (l = 'Mail' AND NOT ({_MAIL}))""",
    "forms_valid": "SELECT o_custkey AS form, count(*) FILTER (bad) = 0 AS all_valid, count(*) FILTER (bad) AS errors FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN o_orderkey % 8 = 1 ELSE true END AS bad FROM orders) GROUP BY o_custkey",
}
