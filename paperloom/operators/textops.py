"""Text operators: entities, label and value lines, direction, search, replace, redaction, chunking, routing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.literals import frame, values
from paperloom.functions.text import human_size, safe_file_name
from paperloom.operators import forms
from paperloom.operators.forms import ontology_key
from paperloom.sources.tables import read, spread

#: Kinds of loose values and what they look like.
ENTITIES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b",
    "date": r"\b[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "phone": r"\+?[0-9][0-9 \t\n\r/()-]{6,}[0-9]",
    "postal_code": r"\b[0-9]{5}\b",
}
EXTRA_TEXTS = [(-1, "IBAN DE89370400440532013000 born 1990-03-15, or 15.3.1990; zip 10115 call +49 176 1234567"), (-2, "mail a.b@x.org and a.b@x.org, c@d.io"), (-3, "")]
RTL = "֐-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
LTR = "A-Za-zÀ-ɏ"
RTL_TEXTS = [(-1, "مرحبا hello"), (-2, "hello مرحبا بالعالم"), (-3, "123 !"), (-4, "שלום")]
LINES = [(-1, 0, "Name: Ahmad Omar"), (-1, 1, "Geburtsdatum"), (-1, 2, ": 15.03.1990;"), (-1, 3, "City: "), (-1, 4, "Telefon: -0176 1234567,"), (-1, 5, "Nachname"), (-1, 6, "Vorname"), (-1, 7, "Ali")]
SEARCH = "the"


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, ordinal, value): distinct values of each kind in order of appearance; phones have 7 digits or more."""

    def found(kind: str) -> Column:
        hits = F.regexp_extract_all(F.col(text_col), F.lit(ENTITIES[kind]), F.lit(0))
        if kind == "phone":
            hits = F.filter(hits, lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7)
        return F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.transform(hits, lambda v: F.trim(v))).alias("found"))

    kinds = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*map(found, ENTITIES))).alias("k"))
    return kinds.select("doc_id", "k.kind", F.posexplode("k.found").alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal").cast("long"))


def clean_value(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(v), r"^[:\-–]+", ""), "[;,]+$", ""))


def label_values(lines: DataFrame) -> DataFrame:
    """(doc_id, key, value), the first of each key: ``Label: value`` lines, and label lines without digits whose next line is not a label."""
    order = Window.partitionBy("doc_id").orderBy("line")
    raw = F.trim("text")
    colon = F.instr(raw, ":")
    inline = (colon > 1) & (colon < F.length(raw))
    own = lines.withColumn("next", F.lead("text").over(order)).withColumn("raw", raw).where("raw <> ''")
    key = F.when(inline, ontology_key(F.trim(F.substring_index("raw", ":", 1)))).when(~F.col("raw").rlike("[0-9]"), ontology_key(F.col("raw")))
    value = F.when(inline, clean_value(F.expr("substring(raw, instr(raw, ':') + 1)"))).otherwise(clean_value(F.col("next")))
    rows = own.withColumn("inline", inline).withColumn("key", key).withColumn("value", value)
    rows = rows.where(F.col("key").isNotNull() & (F.coalesce("value", F.lit("")) != "") & (F.length("value") <= 80) & (F.col("inline") | ontology_key(F.col("value")).isNull()))
    return rows.groupBy("doc_id", "key").agg(F.min_by("value", "line").alias("value"))


def direction(text: Column) -> Column:
    """Struct (rtl: the first strong character is right-to-left, majority_rtl, alignment)."""
    first = F.regexp_extract(text, f"[{RTL}{LTR}]", 0)
    rtl = first.rlike(f"[{RTL}]")
    majority = F.regexp_count(text, F.lit(f"[{RTL}]")) > F.regexp_count(text, F.lit(f"[{LTR}]"))
    return F.struct(rtl.alias("rtl"), majority.alias("majority_rtl"), F.when(rtl, "right").otherwise("left").alias("alignment"))


def occurrences(text: Column, needle: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """How often the text holds the needle, not overlapping. Word characters are ASCII letters, digits, _ and all beyond ASCII."""
    body = "".join("\\" + c if not c.isalnum() and c != " " else c for c in needle)
    edge = "[0-9A-Za-z_\\u0080-\\uffff]"
    pattern = f"(?<!{edge}){body}(?!{edge})" if whole_word else body
    return F.regexp_count(text if case_sensitive else F.lower(text), F.lit(pattern if case_sensitive else pattern.replace(body, body.lower()))).cast("long")


def redacted(text: Column, needles: list[str], mark: str = "[redacted]") -> Column:
    """Every needle replaced, in any case, the longest first."""
    return reduce(lambda x, n: F.regexp_replace(x, "(?i)" + re.sub(r"([^\w\s])", r"\\\1", n), mark), sorted(needles, key=len, reverse=True), text)


def replaced(text: Column, needle: str, by: str) -> Column:
    return F.replace(text, F.lit(needle), F.lit(by))


#: Ends to cut after, the best first.
CUTS = (". ", ".\n", "\n\n", "\n", " ")


def chunk_end(text: str, at: int, size: int) -> int:
    """Where the chunk that starts at ``at`` ends: after the last best cut in its second half, else after ``size`` characters."""
    middle, end = at + size // 2, at + size
    if end >= len(text):
        return len(text)
    second_half = text[middle:end]
    return next((middle + second_half.rindex(cut) + len(cut) for cut in CUTS if cut in second_half), end)


def summary_chunks_of(docs: DataFrame, size: int = 3000) -> DataFrame:
    """(doc_id, chunk, start, text); each cut depends on the one before it, so a text's chunks come from one pass over that text."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"].fillna("")):
                starts = [0]
                while (end := chunk_end(text, starts[-1], size)) < len(text):
                    starts.append(end)
                rows += [(doc_id, n, a, text[a:b]) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk long, start long, text string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(_docs(spark, sf_dir).unionByName(frame(spark, EXTRA_TEXTS, "doc_id long, text string")))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_extract(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def label_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return label_values(lines.withColumn("line", F.col("line").cast("long")).unionByName(frame(spark, LINES, "doc_id long, line long, text string")))


def rtl_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).unionByName(frame(spark, RTL_TEXTS, "doc_id long, text string"))
    return rows.select("doc_id", direction(F.col("text")).alias("d")).select("doc_id", "d.*")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", occurrences(t, SEARCH).alias("loose"), occurrences(t, "The", True).alias("cased"))


def search_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", occurrences(F.col("text"), SEARCH, whole_word=True).alias("n"))


def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = replaced(F.col("text"), "the", "THE")
    return _docs(spark, sf_dir).select("doc_id", F.md5(x).alias("md5"), occurrences(F.col("text"), "the", True).alias("n"))


NEEDLES = ["General Public License", "License", "secret", "All rights reserved."]


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = redacted(F.col("text"), NEEDLES)
    left = reduce(lambda a, b: a | b, [F.lower(x).contains(n.lower()) for n in NEEDLES])
    return _docs(spark, sf_dir).select("doc_id", F.md5(x).alias("md5"), left.alias("needle_left"))


def redact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences per needle and the documents that hold it."""
    rows = _docs(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), occurrences(F.col("text"), n).alias("n")) for n in NEEDLES])).alias("x"))
    return rows.select("x.*").groupBy("needle").agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 0).alias("documents"))


def scan_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document needs OCR unless some page (here: line) has more than 50 characters after trimming."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg((~F.bool_or(F.length(F.trim("line")) > 50)).alias("scanned"))


def summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 12,000 characters are summarised in chunks, others whole."""
    n = F.length("text")
    return _docs(spark, sf_dir).select("doc_id", (n > 12000).alias("map_reduce"), F.when(n > 12000, F.ceil(n / 3000)).otherwise(1).cast("long").alias("nominal_chunks"))


def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_chunks_of(_docs(spark, sf_dir)).select("doc_id", "chunk", "start", F.length("text").cast("long").alias("n_chars"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", safe_file_name(F.element_at(F.split("url", "/"), -1)).alias("name"), human_size(F.length("html") * 37).alias("size"))


def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a model's answer without numbering, the first three."""
    cleaned = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[0-9.\-) ]+", "")), lambda x: x != "")
    rows = _docs(spark, sf_dir).select("doc_id", F.slice(cleaned, 1, 3).alias("q"))
    return rows.select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "\n")).alias("md5"))


_ALL = (entity_extract, entity_counts, label_value_lines, rtl_direction, search_hits, search_whole_words, replace_text, redact_text, redact_report, scan_route, summary_plan, summary_chunks, file_names, question_lines)
QUERIES = {f.__name__: f for f in _ALL}

_E = f"e AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(EXTRA_TEXTS, 'a, b', 'x')})"
_ENT = ", ".join(["x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, list_transform(regexp_extract_all(text, '{p}'), lambda v: trim(v)) AS found FROM e" for k, p in ENTITIES.items()) + ")", "y AS (SELECT doc_id, kind, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM x)", "z AS (SELECT doc_id, kind, value, min(i) AS i FROM y WHERE kind <> 'phone' OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 GROUP BY ALL)"])
_RED = "text"
for _n in sorted(NEEDLES, key=len, reverse=True):
    _RED = f"regexp_replace({_RED}, '{re.sub(r'([^\w\s])', r'\\\1', _n)}', '[redacted]', 'gi')"


def _count(needle: str, text: str = "lower(text)") -> str:
    return f"CAST((length({text}) - length(replace({text}, '{needle}', ''))) / {len(needle)} AS BIGINT)"


def _chunk_end(at: str) -> str:
    """chunk_end() for chunks of 3000: the last place of a cut comes first in the reversed text."""
    half = f"substr(text, {at} + 1501, 1500)"
    codes = [" || ".join(f"chr({ord(c)})" for c in cut) for cut in CUTS]
    back = [" || ".join(f"chr({ord(c)})" for c in reversed(cut)) for cut in CUTS]
    cuts = " ".join(f"WHEN contains({half}, {c}) THEN {at} + 1501 + length({half}) - instr(reverse({half}), {b})" for c, b in zip(codes, back))
    return f"CASE WHEN {at} + 3000 >= length(text) THEN length(text) {cuts} ELSE {at} + 3000 END"


def _key(label: str) -> str:
    """The ontology key of a label, as a subquery."""
    folded = forms._FOLD.replace("label", label)
    return f"(SELECT arg_min(key, ord) FROM {forms._ONT} WHERE contains({folded}, k) AND {folded} <> '')"


_CLEAN = "trim(regexp_replace(regexp_replace(trim({}), '^[:\\-–]+', ''), '[;,]+$', ''))"
ORACLE_SQL = {
    "label_value_lines": f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) UNION ALL SELECT * FROM {values(LINES, 'a, b, c', 's')}),
 n AS (SELECT doc_id, line, trim(text) AS raw, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM l), i AS (SELECT *, instr(raw, ':') > 1 AND instr(raw, ':') < length(raw) AS inline FROM n WHERE raw <> ''),
 v AS (SELECT doc_id, line, inline, CASE WHEN inline THEN trim(split_part(raw, ':', 1)) WHEN NOT regexp_matches(raw, '[0-9]') THEN raw END AS lab, CASE WHEN inline THEN {_CLEAN.format("substr(raw, instr(raw, ':') + 1)")} ELSE {_CLEAN.format("next")} END AS val FROM i),
 k AS (SELECT doc_id, line, val, {_key("lab")} AS key, inline OR {_key("val")} IS NULL AS good FROM v WHERE coalesce(val, '') <> '' AND length(val) <= 80)
 SELECT doc_id, key, arg_min(val, line) AS value FROM k WHERE key IS NOT NULL AND good GROUP BY doc_id, key""",
    "summary_chunks": f"WITH RECURSIVE c AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start, CAST({_chunk_end('0')} AS BIGINT) AS stop FROM documents UNION ALL SELECT doc_id, text, chunk + 1, stop, CAST({_chunk_end('stop')} AS BIGINT) FROM c WHERE stop < length(text)) SELECT doc_id, chunk, start, stop - start AS n_chars FROM c",
    "entity_extract": f"WITH {_E}, {_ENT} SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) - 1 AS ordinal, value FROM z",
    "entity_counts": f"WITH {_E}, {_ENT} SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM z GROUP BY kind",
    "rtl_direction": f"SELECT doc_id, regexp_matches(f, '[{RTL}]') AS rtl, len(regexp_extract_all(text, '[{RTL}]')) > len(regexp_extract_all(text, '[{LTR}]')) AS majority_rtl, CASE WHEN regexp_matches(f, '[{RTL}]') THEN 'right' ELSE 'left' END AS alignment FROM (SELECT doc_id, text, regexp_extract(text, '[{RTL}{LTR}]') AS f FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(RTL_TEXTS, 'a, b', 'x')}))",
    "search_hits": f"SELECT doc_id, {_count('the')} AS loose, {_count('The', 'text')} AS cased FROM documents",
    "search_whole_words": "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[\\x00-/:-@\\[-^`{-\\x7f]+'), lambda w: w = 'the')) AS BIGINT) AS n FROM documents",
    "replace_text": f"SELECT doc_id, md5(replace(text, 'the', 'THE')) AS md5, {_count('the', 'text')} AS n FROM documents",
    "redact_text": f"SELECT doc_id, md5(x) AS md5, {' OR '.join(f"contains(lower(x), '{n.lower()}')" for n in NEEDLES)} AS needle_left FROM (SELECT doc_id, {_RED} AS x FROM documents)",
    "redact_report": " UNION ALL ".join(f"SELECT '{n}' AS needle, CAST(sum({_count(n.lower())}) AS BIGINT) AS occurrences, count(*) FILTER ({_count(n.lower())} > 0) AS documents FROM documents" for n in NEEDLES),
    "scan_route": "SELECT doc_id, NOT bool_or(length(trim(l)) > 50) AS scanned FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id",
    "summary_plan": "SELECT doc_id, length(text) > 12000 AS map_reduce, CASE WHEN length(text) > 12000 THEN CAST(ceil(length(text) / 3000) AS BIGINT) ELSE 1 END AS nominal_chunks FROM documents",
    "file_names": "SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._\\- ]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120), ''), 'document') AS name, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.1f MB', round(n / 1048576, 1)) END AS size FROM (SELECT *, length(html) * 37 AS n FROM pages)",
    "question_lines": "SELECT doc_id, CAST(len(q) AS BIGINT) AS n, md5(array_to_string(q, chr(10))) AS md5 FROM (SELECT doc_id, (list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[0-9.\\-) ]+', '')), lambda x: x <> ''))[1:3] AS q FROM documents)",
}
