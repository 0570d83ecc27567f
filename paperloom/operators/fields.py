"""Form fields in detail: what a label asks for, which profile key it names, masks and loose dates, values and fill joins.

Keyword tables are bounded fixed values searched in order, so a label needs no join. Joins of fields with values keep
the first match by rank, so each is one equi-join and one aggregate however many fields a form has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import CHECKBOX_GLYPHS, INPUT_KEYWORDS, PROFILE_RULES, RADIO_GLYPHS, TYPE_KEYWORDS
from paperloom.functions.literals import frame, values
from paperloom.operators.forms import first_entry
from paperloom.operators.records import kind_fits
from paperloom.sources.tables import read, spread

#: Labels for the corners that texts seldom hold.
LABELS = [
    "Name:", "E-Mail Adresse", "Geburtsdatum (TT.MM.JJJJ)", "Place of birth", "Ort, Datum", "Telefon", "PLZ", "Hausnummer", "Unterschrift", "☐", "○", "x", "O", "()", "[ ]", "ja", "Nein", "divers?",
    "____", "Betrag in EUR", "Datum: MM/DD/YYYY", "Date YYYY-MM-DD", "3 Vorname", "First name", "Straße und Nr.", "   ", "", "IBAN", "Valid until", "Total sum", "Sign here please", "Reisepass Nr.", "a label far too long to be one, going on and on and on and on",
    "Resort", "Ort", "Nationality:", "código postal", "تاريخ الميلاد", "E mail", "fax no.",
]


def has_any(x: Column, keys: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keys)), lambda k: x.contains(k))


def glyph_kind(label: Column) -> Column:
    """Checkbox or radio button for a glyph that stands for one, else null."""
    t = F.trim(label)
    box = (F.length(t) <= 3) & (t.rlike(r"^[\[\]()" + CHECKBOX_GLYPHS[4:] + "]+$") | t.rlike("^[xX]$"))
    round_ = (F.length(t) <= 2) & (t.rlike(f"^[{RADIO_GLYPHS}]+$") | t.isin("O", "o"))
    return F.when(box, "checkbox").when(round_, "radio")


def label_type(label: Column) -> Column:
    """The type that a printed label suggests; ``text`` if none."""
    s = F.lower(label)
    out = F.when(has_any(s, TYPE_KEYWORDS["signature"]), "signature").when(glyph_kind(label).isNotNull(), glyph_kind(label))
    out = out.when((F.length(F.trim(s)) <= 12) & has_any(s, TYPE_KEYWORDS["option"]), "checkbox")
    for kind in ("email", "date", "phone", "number", "name"):
        out = out.when(has_any(s, TYPE_KEYWORDS[kind]), kind)
    return out.otherwise("text")


def is_field_label(label: Column) -> Column:
    s = F.trim(label)
    return (s != "") & (F.length(s) <= 60) & (s.endswith(":") | s.rlike("_{2,}") | glyph_kind(s).isNotNull() | (label_type(s) != "text"))


def profile_key(label: Column) -> Column:
    s = F.trim(F.replace(F.lower(label), F.lit(":"), F.lit(" ")))
    return F.when(s != "", first_entry([(k, key) for key, words in PROFILE_RULES.items() for k in words], s, lambda v, k: v.contains(k)))


def readable_name(name: Column) -> Column:
    """``form.txtFirst_name`` -> ``First name``."""
    last = F.regexp_replace(F.substring_index(name, ".", -1), r"[_\-]+", " ")
    return F.trim(F.regexp_replace(last, r"(?i)^(txt|tf|fld|field)\s*", ""))


def printed_label(label: Column) -> Column:
    """A question's number is not part of its label."""
    return F.trim(F.regexp_replace(label, r"^[0-9]{1,3}[.)]?\s+", ""))


_DATE_LETTERS = r"\b([TtDdMmJjYy]{1,4})([./\-])([TtDdMmJjYy]{1,4})\2([TtDdMmJjYy]{2,4})\b"


def date_pattern_in(label: Column) -> Column:
    """The date pattern that a label spells out, as day d, month M and year y; null if none."""

    def part(i: int) -> Column:
        p = F.regexp_extract(label, _DATE_LETTERS, i)
        first = F.lower(F.substring(p, 1, 1))
        return F.repeat(F.when(first.isin("t", "d"), "d").when(first == "m", "M").otherwise("y"), F.length(p))

    mark = F.regexp_extract(label, _DATE_LETTERS, 2)
    return F.when(label.rlike(_DATE_LETTERS), F.concat(part(1), mark, part(3), mark, part(4)))


def field_pattern(pattern: Column) -> Column:
    """A form's own date pattern, in which m is the month and M the minute, with the letters the other way round."""
    turned = F.replace(F.translate(pattern, "mMt", "Mma"), F.lit("aa"), F.lit("a"))
    return F.when(F.trim(pattern) != "", turned)


def field_input(label: Column, name: Column, form: Column, pattern: Column, multiline: Column) -> Column:
    """Struct (input, date_pattern): what a field takes, by its own format, else by the words of label and name."""
    own = F.lower(F.concat_ws(" ", label, name))
    place = has_any(own, INPUT_KEYWORDS["place"]) | own.rlike("(^|[^a-z])ort([^a-z]|$)")
    kind = F.when(form.isNotNull(), form).when(multiline, "multiline").when(has_any(own, INPUT_KEYWORDS["email"]), "email").when(has_any(own, INPUT_KEYWORDS["date"]) & ~place, "date")
    for k in ("phone", "zip", "number"):
        kind = kind.when(has_any(own, INPUT_KEYWORDS[k]), k)
    spelled = date_pattern_in(label)
    pattern = F.when(form == "date", F.coalesce(field_pattern(pattern), spelled)).when(form.isNull() & (kind.otherwise("text") == "date"), F.coalesce(spelled, F.lit("dd.MM.yyyy")))
    return F.struct(kind.otherwise("text").alias("input"), pattern.alias("date_pattern"))


def masked_digits(digits: Column, pattern: Column) -> Column:
    """Typed digits in a date pattern, with its separators; a completed part is followed by one at once."""
    letters = F.filter(F.split(pattern, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("d"), F.lit(False).alias("over"))

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[dMy]")
        left = acc["d"] < F.length(digits)
        digit = F.substring(digits, acc["d"] + 1, F.lit(1))
        # Beyond the last digit one separator more, if there is any digit.
        last = ~left & ~letter & ~acc["over"] & (F.length(digits) > 0)
        out = F.when(left & letter, F.concat(acc["out"], digit)).when(left | last, F.concat(acc["out"], c)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(left & letter, acc["d"] + 1).otherwise(acc["d"]).alias("d"), (acc["over"] | ~left).alias("over"))

    return F.aggregate(letters, start, step, lambda acc: acc["out"])


def rolled_date(text: Column) -> Column:
    """DD.MM.YYYY, YYYY-MM-DD or DD/MM/YYYY as a date; days and months beyond the calendar roll over."""
    dotted, iso, slashed = r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"

    def made(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
        first = F.make_date(part(y), F.lit(1), F.lit(1))
        return F.date_add(F.add_months(first, part(m) - 1), part(d) - 1)

    return F.when(text.rlike(dotted), made(dotted, 3, 2, 1)).when(text.rlike(iso), made(iso, 1, 2, 3)).when(text.rlike(slashed), made(slashed, 3, 2, 1))


def loose_number(text: Column) -> Column:
    """Commas as points, all else but digits gone; null if that is no number."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double")


def whole_name(names: Column) -> Column:
    """A map of info with first, last and full name derived from each other where they are missing."""
    full = F.filter(F.split(names["full_name"], r"\s+"), lambda p: p != "")
    split = F.when(F.size(full) >= 2, F.map_from_arrays(F.array(F.lit("first_name"), F.lit("last_name")), F.array(F.get(full, F.lit(0)), F.array_join(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), " "))))
    joined = F.when(names["full_name"].isNull() & names["first_name"].isNotNull() & names["last_name"].isNotNull(), F.create_map(F.lit("full_name"), F.concat_ws(" ", names["first_name"], names["last_name"])))
    more = F.coalesce(split, joined, F.create_map().cast("map<string,string>"))
    return F.map_concat(names, F.map_filter(more, lambda k, v: ~F.map_contains_key(names, k)))


def resolved_value(key: Column, kind: Column, info: Column, loose: Column, profile: Column) -> Column:
    """Struct (value, score) of the best candidate that fits the kind: labelled 0.95, synthesised name 0.8, loose 0.65, profile 0.55; null if none."""

    def said(m: Column, k: Column) -> Column:
        return F.nullif(F.trim(F.coalesce(m[k], F.lit(""))), F.lit(""))

    part = lambda k: F.trim(F.coalesce(info[k], profile[k], F.lit("")))
    name = F.coalesce(said(info, F.lit("full_name")), F.nullif(F.trim(F.concat_ws(" ", part("first_name"), part("last_name"))), F.lit("")))
    options = [(said(info, key), 0.95), (F.when((kind == "signature") | (key == "full_name"), name), 0.8), (loose, 0.65), (said(profile, key), 0.55)]
    each = F.array(*[F.struct(v.alias("value"), F.lit(s).alias("score")) for v, s in options])
    return F.get(F.filter(each, lambda c: c["value"].isNotNull() & kind_fits(kind, c["value"])), F.lit(0))


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def merge_mappings(results: DataFrame, found: DataFrame) -> DataFrame:
    """(form, pos, field_name, profile_field, confidence): found mappings fill a form's unmapped rows of the same name, in order.

    A found mapping without a key leaves its row unmapped, so the next one of that name meets the same row again.
    """
    order = Window.partitionBy("form", "field_name").orderBy("pos")
    open_ = results.where("profile_field IS NULL").withColumn("slot", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum(F.col("profile_field").isNotNull().cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = found.withColumn("slot", before).groupBy("form", "field_name", "slot").agg(F.max_by(F.struct(F.col("profile_field").alias("key"), F.col("confidence").alias("sure")), "pos").alias("f"))
    filled = open_.join(last, ["form", "field_name", "slot"], "left").select("form", "pos", "field_name", F.col("f.key").alias("profile_field"), F.coalesce("f.sure", "confidence").alias("confidence"))
    return results.where("profile_field IS NOT NULL").select("form", "pos", "field_name", "profile_field", "confidence").unionByName(filled)


# Queries over the tables.


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, and LABELS as document -1."""
    lines = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "label")).where("label IS NOT NULL")
    return lines.unionByName(frame(spark, [(-1, i, x) for i, x in enumerate(LABELS)], "doc_id long, line int, label string"))


def label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), label_type(F.col("label")).alias("kind"), is_field_label(F.col("label")).alias("is_label"))


def profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labels(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), profile_key(F.col("label")).alias("profile_key"))
    return found.where("profile_key IS NOT NULL")


def field_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a field's label; names, formats and patterns by its number."""
    n = F.col("line")
    form = F.when(n % 7 == 0, F.get(F.array(*map(F.lit, ("date", "time", "number", "zip", "phone"))), n % 5))
    pattern = F.get(F.array(*map(F.lit, ("dd.mm.yyyy", "mm/dd/yy", " ", "HH:MM tt"))), n % 4)
    rows = _labels(spark, sf_dir).select("doc_id", "line", printed_label(F.col("label")).alias("label"), readable_name(F.concat(F.lit("page.txtField_"), n.cast("string"))).alias("name"), form.alias("form"), pattern.alias("pattern"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), "name", field_input(F.col("label"), F.col("name"), F.col("form"), F.col("pattern"), n % 11 == 0).alias("x")).select("doc_id", "line", "name", "x.*")


def date_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates, typed up to a digit."""
    k = F.col("o_orderkey")
    pattern = F.get(F.array(*map(F.lit, ("dd.MM.yyyy", "yyyy-MM-dd", "d/M/yy"))), (k % 3).cast("int"))
    typed = F.substring(F.date_format("o_orderdate", "ddMMyyyy"), F.lit(1), (k % 9).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", masked_digits(typed, pattern).alias("masked"))


def rolled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates in three forms, with days and months moved beyond the calendar; prices as loose numbers."""
    day, month, year = F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 40, F.month("o_orderdate") + F.col("o_orderkey") % 9, F.year("o_orderdate")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    y = year.cast("string")
    forms = F.array(F.concat_ws(".", two(day), two(month), y), F.concat_ws("-", y, two(month), two(day)), F.concat_ws("/", two(day), two(month), y), F.concat_ws(".", day.cast("string"), month.cast("string"), y))
    price = F.get(F.array(F.concat(F.lit("EUR "), F.floor("o_totalprice").cast("string"), F.lit(",50")), F.lit("1.234,56"), F.lit("-7"), F.lit("none")), (F.col("o_orderkey") % 4).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.get(forms, (F.col("o_orderkey") % 4).cast("int")).alias("text"), price.alias("price"))
    return rows.select("o_orderkey", rolled_date(F.col("text")).cast("string").alias("day"), loose_number(F.col("price")).alias("number"))


#: What a form is filled with: key, value, in order.
FILL = [("name", "Ann"), ("customer", "C"), ("building", "B"), ("auto", "A"), ("000000001", "one"), ("household", "H")]


def widget_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as widgets, named by segment and labelled by name: the first key in the name or label, or around the name, decides."""
    name, label = F.lower(F.coalesce("c_mktsegment", F.lit(""))), F.lower(F.coalesce("c_name", F.lit("")))
    both = read(spark, sf_dir, "customer").select("c_custkey", F.struct(name.alias("name"), label.alias("label")).alias("w"))
    return both.select("c_custkey", first_entry(FILL, F.col("w"), lambda w, k: w["name"].contains(k) | w["label"].contains(k) | k.contains(w["name"])).alias("value")).where("value IS NOT NULL")


def detected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as detected fields of their customer's form, each with the form's first filled value of that label."""
    orders = read(spark, sf_dir, "orders")
    fields = orders.select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("field"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("own"))
    filled = orders.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("form"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("value"))
    first = first_by(filled, ["form", "label"], "pos").select("form", "label", "value")
    return fields.join(first, ["form", "label"], "left").select("field", F.coalesce(F.nullif("value", F.lit("")), "own").alias("suggested"))


def mapping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mapped rows of their customer's form, line items as the model's mappings."""
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("field_name"), F.when(F.col("o_orderkey") % 4 == 0, "instant").alias("profile_field"), F.when(F.col("o_orderkey") % 4 == 0, 0.95).otherwise(0.0).alias("confidence"))
    found = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("field_name"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("ai"), F.col("o_orderkey").cast("string"))).alias("profile_field"), F.when(F.col("o_orderkey") % 2 == 0, 0.9).otherwise(0.7).alias("confidence"))
    return merge_mappings(rows, found)


def value_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' info and profile for four keys."""
    k = F.col("c_custkey")
    empty = F.create_map().cast("map<string,string>")

    def some(when: Column, key: str, value: Column) -> Column:
        return F.when(when, F.create_map(F.lit(key), value)).otherwise(empty)

    info = whole_name(F.map_concat(some(k % 2 == 0, "full_name", F.concat(F.lit("Ann "), F.col("c_name"))), some(k % 4 == 1, "first_name", F.lit("Bob")), some(k % 8 == 1, "last_name", F.col("c_name")), some(k % 5 == 0, "email", F.when(k % 3 == 0, "no address").otherwise("a@b.c"))))
    profile = F.map_concat(some(k % 3 == 0, "first_name", F.lit(" Eve ")), some(k % 7 == 0, "email", F.lit("p@q.r")), some(k % 2 == 1, "date_of_birth", F.col("c_mktsegment")))
    loose = F.when(k % 6 == 0, F.concat(F.lit("l"), k.cast("string"), F.lit("@m.n")))
    asked = F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("kind")) for a, b in (("first_name", "name"), ("full_name", "name"), ("email", "email"), ("date_of_birth", "date"))])
    rows = read(spark, sf_dir, "customer").select("c_custkey", info.alias("info"), profile.alias("profile"), loose.alias("loose"), F.explode(asked).alias("a"))
    loose_of = F.when(F.col("a.kind") == "email", F.col("loose"))
    found = rows.select("c_custkey", F.col("a.key").alias("key"), resolved_value(F.col("a.key"), F.col("a.kind"), F.col("info"), loose_of, F.col("profile")).alias("x"))
    return found.where("x IS NOT NULL").select("c_custkey", "key", "x.value", "x.score")


def anchored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per page (customer) and anchor (priority)."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.lower(F.trim("o_orderpriority")).alias("anchor"), "o_orderkey")
    return first_by(rows, ["page", "anchor"], "o_orderkey")


def form_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by folded label, newer ones over older ones; blank labels and values are left out."""
    o = read(spark, sf_dir, "orders")
    key = F.regexp_replace(F.trim(F.lower(F.concat(F.lit(" Field  "), F.col("o_orderpriority")))), r"\s+", " ")
    rows = o.select(F.col("o_custkey").alias("owner"), key.alias("key"), F.trim(F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("value"), "o_orderkey")
    return rows.where("key <> '' AND value <> ''").groupBy("owner", "key").agg(F.max_by("value", "o_orderkey").alias("value"))


QUERIES = {f.__name__: f for f in (label_types, profile_keys, field_inputs, date_masks, rolled_dates, widget_values, detected_values, mapping_merge, value_resolution, anchored_fields, form_memory)}


# The same in SQL.


def _q(s: str) -> str:
    return s.replace("'", "''")


def _any(x: str, keys: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{_q(k)}')" for k in keys) + ")"


_L = f"""SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS line, unnest(x) AS label FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
 UNION ALL SELECT * FROM {values([(-1, i, x) for i, x in enumerate(LABELS)], "doc_id, line, label", "l")}"""
_BOX = f"(length(t) <= 3 AND (regexp_matches(t, '^[\\[\\]()□☐☑☒■◻◼⬜]+$') OR t IN ('x', 'X')))"
_ROUND = "(length(t) <= 2 AND (regexp_matches(t, '^[○◎◉◯⚪⚫]+$') OR t IN ('O', 'o')))"
_KIND = f"CASE WHEN {_any('s', TYPE_KEYWORDS['signature'])} THEN 'signature' WHEN {_BOX} THEN 'checkbox' WHEN {_ROUND} THEN 'radio' WHEN length(t) <= 12 AND {_any('s', TYPE_KEYWORDS['option'])} THEN 'checkbox' {' '.join(f"WHEN {_any('s', TYPE_KEYWORDS[k])} THEN '{k}'" for k in ('email', 'date', 'phone', 'number', 'name'))} ELSE 'text' END"
_INPUT = f"""CASE WHEN form IS NOT NULL THEN form WHEN line % 11 = 0 THEN 'multiline' WHEN {_any('own', INPUT_KEYWORDS['email'])} THEN 'email'
 WHEN {_any('own', INPUT_KEYWORDS['date'])} AND NOT ({_any('own', INPUT_KEYWORDS['place'])} OR regexp_matches(own, '(^|[^a-z])ort([^a-z]|$)')) THEN 'date' {' '.join(f"WHEN {_any('own', INPUT_KEYWORDS[k])} THEN '{k}'" for k in ('phone', 'zip', 'number'))} ELSE 'text' END"""
_LETTERS = r"\b([TtDdMmJjYy]{1,4})([./-])([TtDdMmJjYy]{1,4})([./-])([TtDdMmJjYy]{2,4})\b"


def _part(i: int) -> str:
    p = f"regexp_extract(label, '{_LETTERS}', {i})"
    return f"repeat(CASE lower(left({p}, 1)) WHEN 't' THEN 'd' WHEN 'd' THEN 'd' WHEN 'm' THEN 'M' ELSE 'y' END, length({p}))"


_SPELLED = f"CASE WHEN regexp_matches(label, '{_LETTERS}') AND regexp_extract(label, '{_LETTERS}', 2) = regexp_extract(label, '{_LETTERS}', 4) THEN {_part(1)} || regexp_extract(label, '{_LETTERS}', 2) || {_part(3)} || regexp_extract(label, '{_LETTERS}', 2) || {_part(5)} END"
_LETTER = "regexp_matches(p[i], '[dMy]')"
_COUNT = "length(regexp_replace(p[1:i], '[^dMy]', '', 'g'))"
_SURE = "CASE WHEN o_orderkey % 4 = 0 THEN 0.95 ELSE 0.0 END"
ORACLE_SQL = {
    "label_types": f"SELECT doc_id, line, {_KIND} AS kind, t <> '' AND length(t) <= 60 AND (t LIKE '%:' OR regexp_matches(t, '_{{2,}}') OR {_BOX} OR {_ROUND} OR {_KIND} <> 'text') AS is_label FROM (SELECT *, lower(label) AS s, trim(label) AS t FROM ({_L}))",
    "profile_keys": f"SELECT * FROM (SELECT doc_id, line, CASE {' '.join(f"WHEN {_any('s', words)} THEN '{k}'" for k, words in PROFILE_RULES.items())} END AS profile_key FROM (SELECT *, replace(lower(label), ':', ' ') AS s FROM ({_L}))) WHERE profile_key IS NOT NULL",
    "field_inputs": f"""WITH f AS (SELECT doc_id, line, trim(regexp_replace(label, '^[0-9]{{1,3}}[.)]?\\s+', '')) AS label, 'Field ' || line AS raw, CASE WHEN line % 7 = 0 THEN ['date', 'time', 'number', 'zip', 'phone'][line % 5 + 1] END AS form, ['dd.MM.yyyy', 'MM/dd/yy', NULL, 'HH:mm a'][line % 4 + 1] AS pattern FROM ({_L})),
 g AS (SELECT *, trim(regexp_replace(raw, '(?i)^(txt|tf|fld|field)\\s*', '')) AS bare FROM f), n AS (SELECT *, raw AS name, lower(label || ' ' || raw) AS own, {_SPELLED} AS spelled FROM g), k AS (SELECT *, {_INPUT} AS input FROM n)
 SELECT doc_id, line, name, input, CASE WHEN form = 'date' THEN coalesce(pattern, spelled) WHEN form IS NULL AND input = 'date' THEN coalesce(spelled, 'dd.MM.yyyy') END AS date_pattern FROM k""",
    "date_masks": f"""WITH o AS (SELECT o_orderkey, left(strftime(o_orderdate, '%d%m%Y'), o_orderkey % 9) AS d, ['dd.MM.yyyy', 'yyyy-MM-dd', 'd/M/yy'][o_orderkey % 3 + 1] AS p FROM orders),
 c AS (SELECT o_orderkey, d, p, unnest(range(1, length(p) + 1)) AS i FROM o), k AS (SELECT o_orderkey, i, CASE WHEN {_LETTER} THEN d[{_COUNT}] ELSE p[i] END AS x FROM c WHERE {_COUNT} <= length(d) AND length(d) > 0)
 SELECT o_orderkey, coalesce(string_agg(x, '' ORDER BY i), '') AS masked FROM o LEFT JOIN k USING (o_orderkey) GROUP BY o_orderkey""",
    "rolled_dates": """WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS f, day(o_orderdate) + o_orderkey % 40 AS d, month(o_orderdate) + o_orderkey % 9 AS m, year(o_orderdate) AS y, o_totalprice AS p FROM orders)
 SELECT o_orderkey, CASE WHEN f < 3 OR (d >= 10 AND m >= 10) THEN CAST(CAST(make_date(y, 1, 1) + to_months(CAST(m - 1 AS INTEGER)) + to_days(CAST(d - 1 AS INTEGER)) AS DATE) AS VARCHAR) END AS day,
 CASE f WHEN 0 THEN floor(p) + 0.5 WHEN 2 THEN 7.0 END AS number FROM d""",
    "widget_values": f"SELECT * FROM (SELECT c_custkey, CASE {' '.join(f"WHEN contains(n, '{k}') OR contains(l, '{k}') OR contains('{k}', n) THEN '{v}'" for k, v in FILL)} END AS value FROM (SELECT c_custkey, lower(coalesce(c_mktsegment, '')) AS n, lower(coalesce(c_name, '')) AS l FROM customer)) WHERE value IS NOT NULL",
    "detected_values": "SELECT o_orderkey AS field, coalesce(nullif((SELECT arg_min(CASE WHEN f.o_orderkey % 2 = 0 THEN f.o_orderstatus ELSE '' END, f.o_orderkey) FROM orders f WHERE f.o_orderkey % 3 = 1 AND f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority), ''), o_orderstatus) AS suggested FROM orders o",
    "mapping_merge": f"""WITH r AS (SELECT o_custkey AS form, o_orderkey AS pos, o_orderstatus AS field_name, CASE WHEN o_orderkey % 4 = 0 THEN 'instant' END AS key, {_SURE} AS sure FROM orders),
 a AS (SELECT o_custkey AS form, o_orderkey AS pos, o_orderstatus AS field_name, CASE WHEN o_orderkey % 5 <> 0 THEN 'ai' || o_orderkey END AS key, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.7 END AS sure FROM orders WHERE o_orderkey % 3 = 0),
 u AS (SELECT *, row_number() OVER (PARTITION BY form, field_name ORDER BY pos) AS n FROM r WHERE key IS NULL), good AS (SELECT *, row_number() OVER (PARTITION BY form, field_name ORDER BY pos) AS n FROM a WHERE key IS NOT NULL),
 last AS (SELECT form, field_name, count(key) + 1 AS n, arg_max(sure, pos) FILTER (key IS NULL) AS sure, max(pos) FILTER (key IS NULL) > coalesce(max(pos) FILTER (key IS NOT NULL), -1) AS after FROM a GROUP BY ALL)
 SELECT form, pos, field_name, key AS profile_field, CAST(sure AS DOUBLE) AS confidence FROM r WHERE key IS NOT NULL
 UNION ALL SELECT u.form, u.pos, u.field_name, good.key, CAST(coalesce(good.sure, CASE WHEN after THEN last.sure END, u.sure) AS DOUBLE) FROM u LEFT JOIN good USING (form, field_name, n) LEFT JOIN last USING (form, field_name, n)""",
    "value_resolution": """WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer),
 i AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Ann ' || name WHEN k % 8 = 1 THEN 'Bob ' || name END AS full_name, CASE WHEN k % 4 = 1 THEN 'Bob' WHEN k % 2 = 0 THEN 'Ann' END AS first_name, CASE WHEN k % 8 = 1 OR k % 2 = 0 THEN name END AS last_name,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'no address' ELSE 'a@b.c' END END AS email, CASE WHEN k % 3 = 0 THEN 'Eve' END AS p_first FROM c),
 x AS (SELECT k, 'first_name' AS key, coalesce(first_name, p_first) AS value, CASE WHEN first_name IS NOT NULL THEN 0.95 ELSE 0.55 END AS score FROM i
 UNION ALL SELECT k, 'full_name', coalesce(full_name, nullif(trim(coalesce(first_name, p_first, '') || ' ' || coalesce(last_name, '')), '')), CASE WHEN full_name IS NOT NULL THEN 0.95 ELSE 0.8 END FROM i
 UNION ALL SELECT k, 'email', CASE WHEN email = 'a@b.c' THEN email WHEN k % 6 = 0 THEN 'l' || k || '@m.n' WHEN k % 7 = 0 THEN 'p@q.r' END, CASE WHEN email = 'a@b.c' THEN 0.95 WHEN k % 6 = 0 THEN 0.65 ELSE 0.55 END FROM i
 UNION ALL SELECT k, 'date_of_birth', CASE WHEN k % 2 = 1 AND regexp_matches(seg, '[0-9]') THEN seg END, 0.55 FROM i)
 SELECT k AS c_custkey, key, value, CAST(score AS DOUBLE) AS score FROM x WHERE value IS NOT NULL AND (key NOT IN ('first_name', 'full_name') OR regexp_matches(value, '[A-Za-zÀ-ÿ]'))""",
    "anchored_fields": "SELECT o_custkey AS page, lower(trim(o_orderpriority)) AS anchor, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
    "form_memory": "SELECT o_custkey AS owner, 'field ' || lower(o_orderpriority) AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY ALL",
}
