"""Form fields: label mapping, validation, batch fill, signature lines, value normalisation.

Mapping tables are ordered and bounded (fixed values), so they become literal arrays searched in order:
the first entry that fits decides, with no join and no shuffle however many labels there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import BATCH_LABELS, FALLBACK_KEYWORDS, INSTANT_LABELS, ONTOLOGY, SIGNATURE_LABELS
from paperloom.functions.literals import frame, pick, values, values_and
from paperloom.functions.text import folded_label
from paperloom.sources.tables import read


def first_case(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    head, *rest = cases
    chain = reduce(lambda c, x: c.when(*x), rest, F.when(*head))
    return chain if default is None else chain.otherwise(default)


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def first_entry(pairs: Sequence[tuple[str, str]], x: Column, fits) -> Column:
    """The value of the first (keyword, value) whose keyword fits x; x is bound once, not made again for every keyword."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    return F.get(F.transform(F.array(x), lambda v: F.get(F.filter(table, lambda e: fits(v, e["k"])), F.lit(0))["v"]), F.lit(0))


def instant_key(label: Column) -> Column:
    """Struct (profile_field, confidence): exact 0.95, else the first entry containing the label or contained in it 0.8, else null and 0."""
    x = F.lower(F.trim(label))
    exact = lookup(x, INSTANT_LABELS)
    partial = first_entry(list(INSTANT_LABELS.items()), x, lambda v, k: v.contains(k) | k.contains(v))
    return F.struct(F.coalesce(exact, partial).alias("profile_field"), F.when(exact.isNotNull(), 0.95).when(partial.isNotNull(), 0.8).otherwise(0.0).alias("confidence"))


def _folded_keyword(k: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        k = k.replace(a, b)
    return k


def ontology_key(label: Column) -> Column:
    x = folded_label(label)
    return F.when(x != "", first_entry([(_folded_keyword(k), key) for key, _, words in ONTOLOGY for k in words], x, lambda v, k: v.contains(k)))


def ontology_kind(key: Column) -> Column:
    return lookup(key, {key: kind for key, kind, _ in ONTOLOGY})


def iban_remainder(iban: Column) -> Column:
    """The number that an IBAN spells, modulo 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    digits = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda acc, c: F.when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97))


#: Python's float grammar, which validators accept for numbers.
FLOAT = r"(?i)^\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)\s*$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DATES = (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}$")


def validation(value: Column, kind: Column) -> Column:
    """Struct (error, suggestion); a null error means valid. Blank values and unknown kinds are valid."""
    v = F.trim(F.coalesce(value, F.lit("")))
    squeezed = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    digits = F.length(F.regexp_replace(v, "[^0-9+]", ""))
    number = F.replace(F.replace(F.replace(v, F.lit(" "), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_at = (kind == "email") & ~v.rlike(EMAIL) & ~v.contains("@") & v.contains(".")
    bad_date = (kind == "date") & ~reduce(lambda a, b: a | b, [v.rlike(p) for p in DATES])
    iban_shape = squeezed.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    error = first_case(
        [
            (v == "", F.lit(None).cast("string")),
            (no_at, F.lit("Missing @ symbol")),
            ((kind == "email") & ~v.rlike(EMAIL), F.lit("Invalid email format")),
            ((kind == "phone") & (digits < 7), F.lit("Phone number too short")),
            ((kind == "phone") & (digits > 16), F.lit("Phone number too long")),
            (bad_date, F.lit("Unrecognized date format")),
            ((kind == "number") & ~number.rlike(FLOAT), F.lit("Not a valid number")),
            ((kind == "iban") & ~F.length(squeezed).between(15, 34), F.lit("IBAN length invalid")),
            ((kind == "iban") & ~iban_shape, F.lit("IBAN format invalid")),
            ((kind == "iban") & (F.when(iban_shape, iban_remainder(squeezed)) != 1), F.lit("IBAN checksum invalid")),
            ((kind == "zip") & ~squeezed.rlike("^[A-Z0-9]{3,10}$"), F.lit("Invalid postal code format")),
            ((kind == "name") & (F.length(v) < 2), F.lit("Name too short")),
            ((kind == "name") & v.rlike(r"\p{Nd}"), F.lit("Name should not contain digits")),
        ]
    )
    suggestion = F.when((v != "") & no_at, F.replace(v, F.lit(" at "), F.lit("@"))).when((v != "") & bad_date, "Use DD.MM.YYYY")
    return F.struct(error.alias("error"), suggestion.alias("suggestion"))


def batch_key(label: Column, profile: Sequence[tuple[str, str]], overrides: Mapping[str, str]) -> Column:
    """Profile key of a label: override, the label itself, alias, first profile key containing it or contained in it."""
    keys = [k for k, _ in profile]
    x = F.lower(F.trim(label))
    alias = {k: v for k, v in BATCH_LABELS.items() if v in keys}
    auto = first_case([(x == k, F.lit(k)) for k in keys] + [(x == k, F.lit(v)) for k, v in alias.items()] + [(x.contains(k) | F.lit(k).contains(x), F.lit(k)) for k in keys])
    return F.coalesce(lookup(label, overrides), auto) if overrides else auto


def batch_fill_fields(fields: DataFrame, profile: Sequence[tuple[str, str]], overrides: Mapping[str, str]) -> DataFrame:
    """Adds profile_key, error and placed (the value that fills the field) to (form, label, kind)."""
    keyed = fields.withColumn("profile_key", batch_key(F.col("label"), profile, overrides))
    value = lookup(F.col("profile_key"), dict(profile))
    checked = keyed.withColumn("value", value).withColumn("check", validation(F.col("value"), F.col("kind")))
    placed = F.when(F.col("check.error").isNull(), F.col("value")).otherwise(F.col("check.suggestion"))
    return checked.withColumn("error", F.when(F.col("value").isNotNull(), F.col("check.error"))).withColumn("placed", F.when(F.col("value").isNotNull(), placed)).drop("check", "value")


def batch_status(filled: DataFrame) -> DataFrame:
    """Per form: detected, filled (distinct labels), uncertain, errors and status."""
    counts = filled.groupBy("form").agg(F.count(F.lit(1)).alias("detected"), F.count_distinct(F.when(F.col("placed").isNotNull(), F.col("label"))).alias("filled"), F.count_if(F.col("placed").isNull()).alias("uncertain"), F.count("error").alias("errors"))
    return counts.withColumn("status", F.when(F.col("filled") == 0, "failed").when(F.col("filled") < F.col("detected"), "partial").otherwise("success"))


def fallback_key(name: Column) -> Column:
    """The first keyword contained in the field's name decides."""
    x = F.lower(name)
    return first_case([(x.contains(k), F.lit(v)) for k, v in FALLBACK_KEYWORDS.items()])


def signature_confidence(text: Column) -> Column:
    x = F.lower(F.trim(text))
    label = reduce(lambda a, b: a | b, [x.contains(k) for k in SIGNATURE_LABELS])
    date = reduce(lambda a, b: a | b, [x.contains(k) for k in ("datum", "date", "ort,", "place,")])
    return F.when(label, 0.9).when(x.rlike(r"_{5,}|\.{5,}|-{5,}|x{3,}"), 0.7).when(date, 0.5).otherwise(0.0)


def signature_fields(lines: DataFrame) -> DataFrame:
    """Lines (text, x, y, w, h) that mark a signature, with its box below them."""
    found = lines.withColumn("confidence", signature_confidence(F.col("text"))).where("confidence >= 0.5")
    return found.withColumn("y", F.col("y") + F.col("h")).withColumn("w", F.greatest("w", F.lit(0.2))).withColumn("h", F.lit(0.04)).withColumn("label", F.substring(F.lower(F.trim("text")), 1, 50)).drop("text")


def normalised_date(value: Column) -> Column:
    """DD.MM.YYYY from ISO and slashed dates; day and month swap only if the second part cannot be a month."""
    v = F.trim(value)
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    parts = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
    a, b, y = (F.regexp_extract(v, parts, i) for i in (1, 2, 3))
    swap = (b.try_cast("int") > 12) & (a.try_cast("int") <= 12)
    day, month = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(v.rlike(iso), F.concat_ws(".", F.regexp_extract(v, iso, 3), F.regexp_extract(v, iso, 2), F.regexp_extract(v, iso, 1))).when(v.rlike(parts), F.concat_ws(".", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), y)).otherwise(v)


def net_and_tax(gross: Column, tax: Column) -> Column:
    """Struct (net, tax) with two decimals; a missing tax is 19 % of gross."""
    t = F.coalesce(tax, gross * 0.19)

    def cents(x: Column) -> Column:
        return F.format_string("%.2f", F.round(x.cast("decimal(18,6)"), 2).cast("double"))

    return F.struct(cents(gross - t).alias("net"), cents(t).alias("tax"))


LABELS = [(i, x) for i, x in enumerate(["Vorname", "Nachname", "E-Mail", "Passport number", "Geburtsdatum", "Date of Birth:", "Vor- und Nachname", "Straße", "Wohnort", "Bundesland", "Kontonummer", "IBAN", "Telefonnummer privat", "zzz", "", "Name des Ehegatten", "Ausweisnummer", "Datum, Unterschrift", "Miete", "Kinder", "Your full name please", "ZIP code", "Prénom", "الاسم الأول", "رقم الهاتف", "Nationalität", "Steuer-ID", "Arbeitgeber", "sex", "qm"])]
CHECKS = [("user@example.com", "email"), ("not-an-email", "email"), ("user at example.com", "email"), ("+49 176 12345678", "phone"), ("123", "phone"), ("12345678901234567", "phone"), ("15.03.1990", "date"), ("1990-03-15", "date"), ("99.99.2024", "date"), ("1.3.90", "date"), ("not a date", "date"), ("1.234,56", "number"), ("42", "number"), ("1e5", "number"), ("nan", "number"), ("1_0", "number"), ("abc", "number"), ("DE89 3704 0044 0532 0130 00", "iban"), ("DE00 1234 5678 9012 3456 78", "iban"), ("DE89", "iban"), ("1234 5678 9012 3456 78", "iban"), ("10115", "zip"), ("1", "zip"), ("SW1A 1AA", "zip"), ("Muhammad Ali", "name"), ("John123", "name"), ("X", "name"), ("any text", "text"), ("", "email"), ("  ", "phone")]
PROFILE = [("first_name", "Ahmad"), ("last_name", "Omar"), ("email", "not-valid.com"), ("phone", "0176 1234567"), ("date_of_birth", "March 1990"), ("zip_code", "10115")]
OVERRIDES = {"Kontakt": "email"}
FIELDS = [(0, "Vorname", "name"), (0, "Nachname", "name"), (0, "Telefon", "phone"), (1, "Email", "email"), (1, "Geburtsdatum", "date"), (1, "Kontakt", "email"), (1, "Hobby", "text"), (2, "Unknown", "text"), (3, "PLZ", "zip"), (3, "PLZ", "zip"), (4, "", "text"), (4, "phone number", "phone")]


def _picked(rows: list[tuple], column: int, i: Column) -> Column:
    return F.get(F.array(*[F.lit(r[column]) for r in rows]), i.cast("int"))


def _varied(label: Column) -> Column:
    """A label as it is, before a customer's name, or before a segment in brackets."""
    return F.concat(label, F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name")).when(F.col("c_custkey") % 3 == 2, F.concat(F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(""))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal labels, and one for each customer."""
    k = F.col("c_custkey")
    own = read(spark, sf_dir, "customer").select((k + 1000).alias("id"), _varied(_picked(LABELS, 1, k % len(LABELS))).alias("label"))
    return frame(spark, LABELS, "id long, label string").unionByName(own)


def form_fields_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal forms, and forms of four customers' fields each."""
    k = F.col("c_custkey")
    own = read(spark, sf_dir, "customer").select(F.floor(k / 4).cast("long").alias("form"), _varied(_picked(FIELDS, 1, k % len(FIELDS))).alias("label"), _picked(FIELDS, 2, k % len(FIELDS)).alias("kind"))
    return frame(spark, FIELDS, "form long, label string, kind string").unionByName(own.withColumn("form", F.col("form") + 1000))


def field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(spark, sf_dir).select("id", instant_key(F.col("label")).alias("m")).select("id", "m.*")


def ontology_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels_of(spark, sf_dir).select("id", ontology_key(F.col("label")).alias("key"))
    return found.withColumn("kind", ontology_kind(F.col("key")))


def field_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("email", "phone", "date", "number", "iban", "zip", "name")))
    texts = F.array(F.date_format("o_orderdate", "dd.MM.yyyy"), F.floor("o_totalprice").cast("string"), F.col("o_orderpriority"), F.concat(F.lit("user"), k.cast("string"), F.lit("@example.org")), F.concat(F.lit("+49 "), (k * 7919).cast("string")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.get(texts, (k % 5).cast("int")).alias("value"), F.get(kinds, (k % 7).cast("int")).alias("kind"))
    rows = frame(spark, CHECKS, "value string, kind string").unionByName(orders)
    return rows.select("value", "kind", validation(F.col("value"), F.col("kind")).alias("c")).select("value", "kind", F.col("c.error").isNull().alias("valid"), "c.error", "c.suggestion")


def batch_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_fill_fields(form_fields_of(spark, sf_dir), PROFILE, OVERRIDES)


def batch_fill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_status(batch_fill(spark, sf_dir))


def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels_of(spark, sf_dir).select("id", fallback_key(F.col("label")).alias("profile_field"))
    value = lookup(F.col("profile_field"), dict(PROFILE))
    return rows.withColumn("value", value).withColumn("confidence", F.when(F.col("value").isNotNull(), 0.7).otherwise(0.0))


def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines, with made-up boxes, and literal lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))
    literal = frame(spark, SIGNATURE_ROWS, "doc_id long, line long, text string")
    boxed = rows.unionByName(literal).withColumn("x", F.lit(0.1)).withColumn("y", F.col("line") % 50 / 50).withColumn("w", F.lit(0.15)).withColumn("h", F.lit(0.02))
    return signature_fields(boxed).select("doc_id", "line", "label", F.round("y", 6).alias("y"), "w", "h", "confidence")


SIGNATURE_ROWS = [(-1, 0, "Ort, Datum, Unterschrift"), (-1, 1, "Authorized Signature: ____"), (-1, 2, "_" * 24), (-1, 3, "This is a normal paragraph about payments."), (-1, 4, "واژۆ"), (-1, 5, "Total amount"), (-1, 6, "Date of issue")]
DATE_ROWS = [("2024-03-05",), ("05.03.2024",), ("3/25/2024",), ("25/3/2024",), ("3-4-2024",), ("13/14/2024",), ("yesterday",), (" 2024-12-31 ",)]


def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    forms = F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy")])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.get(forms, (k % 5).cast("int")).alias("value"))
    return frame(spark, DATE_ROWS, "value string").unionByName(orders).select("value", normalised_date(F.col("value")).alias("normalised"))


def cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net and tax of order prices; every third order states its own tax."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tax = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 0.07)
    return o.select("o_orderkey", net_and_tax(F.col("o_totalprice"), tax).alias("n")).select("o_orderkey", "n.*")


QUERIES = {f.__name__: f for f in (field_map, ontology_match, field_validate, batch_fill, batch_fill_status, fallback_fill, signature_lines, date_normalize, cross_field)}

def _varied_sql(label: str) -> str:
    return f"{label} || CASE c_custkey % 3 WHEN 1 THEN ' ' || c_name WHEN 2 THEN ' (' || c_mktsegment || ')' ELSE '' END"


_LABELS = values_and(LABELS, "id, label", "l", f"SELECT c_custkey + 1000, {_varied_sql(pick(LABELS, 1, f'c_custkey % {len(LABELS)}'))} FROM customer")
_FIELDS = values_and(FIELDS, "form, label, kind", "f", f"SELECT c_custkey // 4 + 1000, {_varied_sql(pick(FIELDS, 1, f'c_custkey % {len(FIELDS)}'))}, {pick(FIELDS, 2, f'c_custkey % {len(FIELDS)}')} FROM customer")
_INSTANT = values([(i, k, v) for i, (k, v) in enumerate(INSTANT_LABELS.items())], "ord, k, v", "m")
_ONT = values([(i, _folded_keyword(k), key, kind) for i, (key, kind, ks) in enumerate(ONTOLOGY) for k in ks], "ord, k, key, kind", "o")
_FOLD = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(label), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[:._,/]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PROFILE = values([(i, k, v) for i, (k, v) in enumerate(PROFILE)], "ord, k, v", "p")
_IBAN = "list_reduce(list_prepend(0, list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: CAST(unicode(c) AS INTEGER))), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END)"


_ORDER_CHECKS = """ UNION ALL SELECT [strftime(o_orderdate, '%d.%m.%Y'), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), o_orderpriority, 'user' || o_orderkey || '@example.org', '+49 ' || o_orderkey * 7919][o_orderkey % 5 + 1],
 ['email', 'phone', 'date', 'number', 'iban', 'zip', 'name'][o_orderkey % 7 + 1] FROM orders"""


def _validated(source: str) -> str:
    """Adds error and suggestion to rows with (value, kind)."""
    dates = " OR ".join(f"regexp_matches(v, '{p}')" for p in DATES)
    return f"""SELECT * EXCLUDE (v, s, n), CASE WHEN v = '' THEN NULL
 WHEN kind = 'email' AND NOT regexp_matches(v, '{EMAIL}') THEN CASE WHEN NOT contains(v, '@') AND contains(v, '.') THEN 'Missing @ symbol' ELSE 'Invalid email format' END
 WHEN kind = 'phone' AND length(regexp_replace(v, '[^0-9+]', '', 'g')) < 7 THEN 'Phone number too short'
 WHEN kind = 'phone' AND length(regexp_replace(v, '[^0-9+]', '', 'g')) > 16 THEN 'Phone number too long'
 WHEN kind = 'date' AND NOT ({dates}) THEN 'Unrecognized date format'
 WHEN kind = 'number' AND NOT regexp_matches(n, '{FLOAT}') THEN 'Not a valid number'
 WHEN kind = 'iban' AND (length(s) < 15 OR length(s) > 34) THEN 'IBAN length invalid'
 WHEN kind = 'iban' AND NOT regexp_matches(s, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') THEN 'IBAN format invalid'
 WHEN kind = 'iban' AND {_IBAN} <> 1 THEN 'IBAN checksum invalid'
 WHEN kind = 'zip' AND NOT regexp_matches(s, '^[A-Z0-9]{{3,10}}$') THEN 'Invalid postal code format'
 WHEN kind = 'name' AND length(v) < 2 THEN 'Name too short'
 WHEN kind = 'name' AND regexp_matches(v, '[0-9]') THEN 'Name should not contain digits' END AS error,
 CASE WHEN v = '' THEN NULL WHEN kind = 'email' AND NOT regexp_matches(v, '{EMAIL}') AND NOT contains(v, '@') AND contains(v, '.') THEN replace(v, ' at ', '@')
 WHEN kind = 'date' AND NOT ({dates}) THEN 'Use DD.MM.YYYY' END AS suggestion
 FROM (SELECT *, trim(coalesce(value, '')) AS v, upper(replace(trim(coalesce(value, '')), ' ', '')) AS s, replace(replace(replace(trim(coalesce(value, '')), ' ', ''), '.', ''), ',', '.') AS n FROM ({source}))"""


_KEYED = f"""SELECT f.*, coalesce(CASE WHEN label = 'Kontakt' THEN 'email' END, (SELECT k FROM {_PROFILE} WHERE k = lower(trim(label))),
 (SELECT v FROM {values(list(BATCH_LABELS.items()), 'k, v', 'b')} WHERE k = lower(trim(label)) AND v IN (SELECT k FROM {_PROFILE})),
 (SELECT arg_min(k, ord) FROM {_PROFILE} WHERE contains(lower(trim(label)), k) OR contains(k, lower(trim(label))))) AS profile_key FROM {_FIELDS}"""
_FILLED = f"SELECT form, label, kind, profile_key, CASE WHEN value IS NOT NULL THEN error END AS error, CASE WHEN value IS NOT NULL THEN CASE WHEN error IS NULL THEN value ELSE suggestion END END AS placed FROM ({_validated(f'SELECT q.*, p.v AS value FROM ({_KEYED}) q LEFT JOIN {_PROFILE} ON p.k = q.profile_key')})"
_SIG = "(" + " OR ".join("contains(t, '" + k.replace("'", "''") + "')" for k in SIGNATURE_LABELS) + ")"
ORACLE_SQL = {
    "field_map": f"SELECT id, coalesce(e, p) AS profile_field, CASE WHEN e IS NOT NULL THEN 0.95::DOUBLE WHEN p IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM (SELECT CAST(id AS BIGINT) AS id, (SELECT v FROM {_INSTANT} WHERE k = lower(trim(label))) AS e, (SELECT arg_min(v, ord) FROM {_INSTANT} WHERE contains(lower(trim(label)), k) OR contains(k, lower(trim(label)))) AS p FROM {_LABELS})",
    "ontology_match": f"SELECT CAST(id AS BIGINT) AS id, arg_min(key, ord) AS key, arg_min(kind, ord) AS kind FROM {_LABELS} LEFT JOIN {_ONT} ON contains({_FOLD}, k) AND {_FOLD} <> '' GROUP BY id",
    "field_validate": f"SELECT value, kind, error IS NULL AS valid, error, suggestion FROM ({_validated('SELECT * FROM ' + values(CHECKS, 'value, kind', 't') + _ORDER_CHECKS)})",
    "batch_fill": f"SELECT CAST(form AS BIGINT) AS form, * EXCLUDE (form) FROM ({_FILLED})",
    "batch_fill_status": f"SELECT *, CASE WHEN filled = 0 THEN 'failed' WHEN filled < detected THEN 'partial' ELSE 'success' END AS status FROM (SELECT CAST(form AS BIGINT) AS form, count(*) AS detected, count(DISTINCT label) FILTER (placed IS NOT NULL) AS filled, count(*) FILTER (placed IS NULL) AS uncertain, count(error) AS errors FROM ({_FILLED}) GROUP BY form)",
    "fallback_fill": f"SELECT CAST(id AS BIGINT) AS id, f AS profile_field, p.v AS value, CASE WHEN p.v IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM (SELECT id, (SELECT arg_min(v, ord) FROM {values([(i, k, v) for i, (k, v) in enumerate(FALLBACK_KEYWORDS.items())], 'ord, k, v', 'm')} WHERE contains(lower(label), k)) AS f FROM {_LABELS}) LEFT JOIN {_PROFILE} ON p.k = f",
    "signature_lines": f"WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) UNION ALL SELECT * FROM {values(SIGNATURE_ROWS, 'a, b, c', 's')}), t AS (SELECT *, lower(trim(text)) AS t FROM l), c AS (SELECT *, CASE WHEN {_SIG} THEN 0.9::DOUBLE WHEN regexp_matches(t, '_{{5,}}|\\.{{5,}}|-{{5,}}|x{{3,}}') THEN 0.7::DOUBLE WHEN contains(t, 'datum') OR contains(t, 'date') OR contains(t, 'ort,') OR contains(t, 'place,') THEN 0.5::DOUBLE ELSE 0 END AS confidence FROM t) SELECT doc_id, CAST(line AS BIGINT) AS line, left(t, 50) AS label, round(line % 50 / 50 + 0.02, 6) AS y, 0.2::DOUBLE AS w, 0.04::DOUBLE AS h, confidence FROM c WHERE confidence >= 0.5",
    "date_normalize": f"SELECT value, CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN v[9:10] || '.' || v[6:7] || '.' || v[1:4] WHEN len(p) = 3 THEN CASE WHEN CAST(p[2] AS INTEGER) > 12 AND CAST(p[1] AS INTEGER) <= 12 THEN lpad(p[2], 2, '0') || '.' || lpad(p[1], 2, '0') ELSE lpad(p[1], 2, '0') || '.' || lpad(p[2], 2, '0') END || '.' || p[3] ELSE v END AS normalised FROM (SELECT *, CASE WHEN regexp_matches(v, '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}$') THEN string_split_regex(v, '[/-]') ELSE [] END AS p FROM (SELECT value, trim(value) AS v FROM (SELECT value FROM {values(DATE_ROWS, 'value', 'd')} UNION ALL SELECT [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%-m/%-d/%Y'), strftime(o_orderdate, '%-d-%-m-%Y'), strftime(o_orderdate, '%Y')][o_orderkey % 5 + 1] FROM orders)))",
    "cross_field": "SELECT o_orderkey, printf('%.2f', CAST(round(CAST(o_totalprice - t AS DECIMAL(18,6)), 2) AS DOUBLE)) AS net, printf('%.2f', CAST(round(CAST(t AS DECIMAL(18,6)), 2) AS DOUBLE)) AS tax FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.07::DOUBLE ELSE o_totalprice * 0.19::DOUBLE END AS t FROM orders)",
}
