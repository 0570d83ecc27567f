"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Texts become sequences of template tokens: numbers, units after numbers and capitalised names turn into
typed placeholders, other words are lower-cased and lose their punctuation. Items are also taken in lower
case, for documents that are in one case throughout. Windows of 8 template
tokens are hashed (three doublings of the word hashes) and joined with those of the benchmark, if at
least half of a window's tokens are words. Items with other windows too, which are mostly names and
numbers, are also searched by windows of the tokens themselves.

Hits of a document and an item form a chain as long as they follow each other in both: at most ``REACH``
tokens apart (or further, if the item has no indexed window in between), and on diagonals of one band,
so that a few words put in, left out or changed do not break it. A chain counts as a leak if it has as
many windows as ``min_span`` tokens in a row, or every window that a shorter item has in one of its
forms, and its slots are consistent, one to one: each value in the item stands for one value in the
document and no two for the same. So a question whose numbers and names were swapped throughout is
caught, and one that only happens to have the same frame is not.

Names that follow each other count as one slot in a second view of both texts, in which tokens have places of their own:
so "Boston" can stand for "New York", though it is one word for two. Chains never mix the views.

An item of fewer than 8 template tokens leaks into documents whose whole template equals its own. If at least
``LITERAL`` of its tokens are words, it is also found inside longer texts, in windows of its own length: its first
word as it is (a sentence's first word is no name), then its template; or all its words in any case of letters.
Null and empty texts have no windows. Repeated rows each count once by (id, text). An item is its id and
text together, so null ids are items too, and two texts under one id are two. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import persisted, unused

WINDOW = 8
#: Tokens that two hits of one chain may lie apart, and the diagonals that a band has.
REACH, BAND = 16, 8
#: Stands for a separator within a number.
INNER = "\x02"
NUMBER = f"[0-9][0-9{INNER}]*"
UNITS = "kg|mg|g|lbs?|oz|km|cm|mm|m|mi|ft|in|mph|kmh|ml|l|%|percent|usd|eur|dollars?|euros?|cents?|miles?|meters?|metres?|kilometers?|kilometres?|feet|inches|hours?|minutes?|seconds?|days?|weeks?|months?|years?|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|a|°c|°f"
#: Words that an item of fewer than WINDOW tokens needs to be looked for inside longer texts.
LITERAL = 4
#: Marks a slot's token; no text keeps this character, nor INNER.
MARK = "\x01"
#: Rows of benchmark windows up to which they are sent to all tasks (24 bytes each); beyond, both sides are shuffled.
MAX_BROADCAST = 1_000_000


def slot_tokens(text: Column) -> Column:
    """The text as template tokens that still hold their slots' values, parted by single spaces."""
    x = F.when(text.contains(MARK) | text.contains(INNER), F.translate(text, MARK + INNER, "  ")).otherwise(text)
    # Lookaheads first: they fail at once where a pattern cannot start.
    n = F.regexp_replace(x, r"[.,:/](?=[0-9])(?<=[0-9].)", INNER)
    n = F.regexp_replace(n, rf"(?i)(?=[0-9])(?<![\p{{L}}\p{{N}}])({NUMBER})\s?({UNITS})(?![\p{{L}}\p{{N}}])", f" {MARK}n$1 {MARK}u$2 ")
    n = F.regexp_replace(n, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}{MARK}{INNER}])({NUMBER})", f" {MARK}n$1 ")
    x = F.when(text.rlike("[0-9]"), n).otherwise(x)
    x = F.regexp_replace(x, r"(?=\p{Lu})(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", f" {MARK}a$1 ")
    return F.trim(F.lower(F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}{MARK}{INNER}]+", " ")))


def joined_names(slots: Column) -> Column:
    """Names in a row as one token."""
    return F.replace(F.regexp_replace(slots, f"({MARK}a[^ ]*) (?={MARK}a)", f"$1{INNER}"), F.lit(f"{INNER}{MARK}a"), F.lit(INNER))


def has_name_runs(slots: Column) -> Column:
    return slots.rlike(f"{MARK}a[^ ]* {MARK}a")


def template_of(slots: Column) -> Column:
    return F.regexp_replace(slots, rf"{MARK}([nua])[^ ]*", f"{MARK}$1")


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def with_windows(df: DataFrame, words: Column, out: str) -> DataFrame:
    """``df`` with the hashes of all windows of 8 words, by three doublings, each a column of its own so that it is made once.

    Explode it with the outer form: for the inner one Spark infers a filter on the array's size, which
    makes the whole chain of columns again, several times over.
    """
    df = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        n = F.greatest(F.size(out) - step, F.lit(0))
        df = df.withColumn(out, F.zip_with(F.slice(out, 1, n), F.slice(out, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
    return df


def plain_of(slots: Column) -> Column:
    """Names as words like any others, in every case of letters the same; numbers and units keep their marks and values, and all tokens their places."""
    return F.replace(slots, F.lit(f"{MARK}a"), F.lit(""))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, text): ``item`` names the pair of id and text."""
    found = benchmark.select(F.xxhash64(F.col(id_col).isNull(), id_col, text_col).alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return found.where(F.col("text").isNotNull()).dropDuplicates(["item"])


def _both_cases(items: DataFrame) -> DataFrame:
    """(item, form, slots, template) of each item as it is (form 0) and in lower case (1), as documents in one case only hold it. Tokens keep their places."""
    texts = F.posexplode(F.array(F.col("text"), F.lower("text")))
    found = items.select("item", texts.alias("form", "text")).withColumn("slots", slot_tokens(F.col("text")))
    return found.select("item", "form", "slots", template_of(F.col("slots")).alias("template"))


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """(h, item, view, item_pos, forms, before, n_0 to n_3): windows with enough words of forms 0, 1 and 3 (names joined, which is view 1), and of items where form 0 lacks some, all windows of plain tokens (form 2).

    ``forms`` has a bit for each form that has the window there; ``before`` is the place of the view's last window of
    other forms than 2 before this one; n_k counts the windows of form k.
    """
    both = _both_cases(items)
    plain = both.where("form = 0").select("item", F.lit(2).alias("form"), tokens(plain_of(F.col("slots"))).alias("words"))
    joined = both.where("form = 0").select("item", F.lit(3).alias("form"), tokens(template_of(joined_names(F.col("slots")))).alias("words"))
    words = both.select("item", "form", tokens(F.col("template")).alias("words")).union(plain).union(joined)
    rows = with_windows(words, F.col("words"), "windows").select("item", "form", "words", F.posexplode_outer("windows").alias("item_pos", "h")).where("h IS NOT NULL")
    literal = F.size(F.filter(F.slice("words", F.col("item_pos") + 1, WINDOW), lambda w: ~w.startswith(MARK)))
    rows = persisted(rows.select("h", "item", "item_pos", "form", (2 * literal >= WINDOW).alias("enough")), "item-windows")
    lacking = rows.where("form = 0 AND NOT enough").select("item").distinct()
    rows = rows.where("form <> 2 AND enough").union(rows.where("form = 2").join(lacking, "item", "left_semi").select(rows.columns))
    totals = rows.groupBy("item").agg(*[F.count_distinct(F.when(F.col("form") == k, F.col("item_pos"))).alias(f"n_{k}") for k in range(4)])
    view = F.when(F.col("form") == 3, 1).otherwise(0).alias("view")
    spans = rows.groupBy("h", "item", view, "item_pos").agg(F.bit_or(F.get(F.array(*[F.lit(1 << k) for k in range(4)]), F.col("form"))).alias("forms"))
    earlier = Window.partitionBy("item", "view").orderBy("item_pos").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(F.col("forms") != 4, F.col("item_pos"))).over(earlier), F.lit(-1))
    return spans.withColumn("before", before).join(totals, "item")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_span: int = 13) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows_hit, span, same_slots): one row for each document and item it holds."""
    bench = _items(benchmark, item_col, item_text)
    spans = persisted(_benchmark_windows(bench), "benchmark-windows")
    few = spans.count() <= MAX_BROADCAST
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    slots = base.select("doc_id", "text_hash", slot_tokens(F.col("text")).alias("slots"))
    slots = slots.withColumn("runs", has_name_runs(F.col("slots")))
    windows = with_windows(slots, tokens(template_of(F.col("slots"))), "windows")
    windows = with_windows(windows, tokens(plain_of(F.col("slots"))), "plain")
    windows = with_windows(windows, F.when(F.col("runs"), tokens(template_of(joined_names(F.col("slots"))))), "joined")
    windows = windows.withColumn("joined", F.coalesce("joined", F.array().cast("array<long>")))
    # One pass over the texts: a place's windows of all three kinds, nulls where there is none or the plain one is no other.
    each = windows.select("doc_id", "text_hash", "runs", F.posexplode_outer(F.arrays_zip("windows", "plain", "joined")).alias("pos", "x")).where("x IS NOT NULL")
    # A text without names in a row is the same in both views (2).
    own, plain = F.when(F.col("runs"), 0).otherwise(2), F.when(F.col("x.plain") != F.col("x.windows"), F.col("x.plain"))
    kinds = [F.struct(of.alias("of"), h.alias("h")) for of, h in ((own, F.col("x.windows")), (own, plain), (F.lit(1), F.col("x.joined")))]
    each = each.select("doc_id", "text_hash", "pos", F.explode_outer(F.array(*kinds)).alias("y")).select("doc_id", "text_hash", "pos", "y.of", "y.h").where("h IS NOT NULL")
    spans = F.broadcast(spans) if few else spans
    hits = each.join(spans, "h").where("of = 2 OR of = view").drop("of").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    # Repeated rows of one id and text are one; their hits are the same.
    hits = persisted(hits.drop("h").distinct(), "window-hits")

    # Bands overlap by half, so what drifts by less than that is whole in one of them.
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.floor((F.col("diagonal") + i * BAND // 2) / BAND).alias("at")) for i in (0, 1)])
    hits = hits.withColumn("band", F.explode(bands))
    own = ["doc_id", "text_hash", "item", "view", "band"]
    order = Window.partitionBy(*own).orderBy("pos", "item_pos")
    last, last_item = F.lag("pos").over(order), F.lag("item_pos").over(order)
    step = F.col("item_pos") - last_item
    follows = (step >= -BAND) & ((step <= REACH) | (last_item >= F.col("before"))) & (F.col("pos") - last <= F.greatest(F.lit(REACH), step) + BAND)
    linked = hits.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    n_of = lambda k: F.count_distinct(F.when(F.col("forms").bitwiseAND(1 << k) != 0, F.col("item_pos")))
    chains = linked.groupBy(*own, "chain", "n_0", "n_1", "n_2", "n_3").agg(F.count_distinct("item_pos").alias("n_hit"), *[n_of(k).alias(f"hit_{k}") for k in range(4)], (F.max("item_pos") + WINDOW - F.min("item_pos")).alias("span"))
    asked = min_span - WINDOW + 1
    enough = F.col("n_hit") >= asked
    for k in range(4):  # each form's hits against its own windows: a document holds an item in one form
        enough |= (F.col(f"n_{k}") > 0) & (F.col(f"hit_{k}") >= F.least(F.lit(asked), F.col(f"n_{k}")))
    chains = chains.where(enough).select(*own, "chain", "n_hit", "span")
    pieces = linked.groupBy(*own, "chain", "diagonal").agg(F.min("item_pos").alias("first"), (F.max("item_pos") + WINDOW - F.min("item_pos")).alias("size"))
    named = chains.select(*[F.col(c).alias(f"_{c}") for c in (*own, "chain")], "n_hit", "span")
    same_chain = pieces["doc_id"].eqNullSafe(named["_doc_id"])
    for c in (*own[1:], "chain"):
        same_chain &= pieces[c] == named[f"_{c}"]
    pieces = persisted(pieces.join(named, same_chain).select(*own, "chain", "diagonal", "first", "size", "n_hit", "span"), "leak-chains")

    of_view = lambda x: F.when(F.col("view") == 1, joined_names(x)).otherwise(x)
    of_chains = pieces.join(bench.select("item", "item_id", slot_tokens(F.col("text")).alias("item_slots")), "item").withColumn("item_words", tokens(of_view(F.col("item_slots")))).drop("item_slots")
    suspects = pieces.select("doc_id", "text_hash").distinct()
    texts = base.join(suspects, base["doc_id"].eqNullSafe(suspects["doc_id"]) & (base["text_hash"] == suspects["text_hash"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), slot_tokens(F.col("text")).alias("doc_slots"))
    both = of_chains.join(texts, of_chains["doc_id"].eqNullSafe(texts["_id"]) & (of_chains["text_hash"] == texts["_hash"])).withColumn("doc_words", tokens(of_view(F.col("doc_slots"))))
    pairs = F.zip_with(F.slice("item_words", F.col("first") + 1, F.col("size")), F.slice("doc_words", F.col("first") + F.col("diagonal") + 1, F.col("size")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # Slots that face a slot of their kind; elsewhere words were changed, or the document is in one case.
    checked = both.select("doc_id", "text_hash", "item", "item_id", "view", "band", "chain", "n_hit", "span", _facing(pairs).alias("slots"))
    checked = checked.groupBy("doc_id", "text_hash", "item", "item_id", "view", "band", "chain", "n_hit", "span").agg(F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    checked = checked.where(_one_to_one(F.col("slots")))
    same = F.forall("slots", lambda p: p["a"] == p["b"])
    found = checked.groupBy("doc_id", "text_hash", "item", "item_id").agg(F.max("n_hit").alias("n_windows_hit"), F.max("span").alias("span"), F.bool_or(same).alias("same_slots")).drop("item")

    whole = _both_cases(bench).join(bench.select("item", "item_id"), "item")
    whole = whole.select("item_id", "template").where((F.col("template") != "") & (F.size(tokens(F.col("template"))) < WINDOW))
    n = F.size(tokens(F.col("template")))
    short = base.select("doc_id", "text_hash", template_of(slot_tokens(F.col("text"))).alias("template")).where(F.length("template") > 0).where(n < WINDOW)
    short = short.join(whole, "template").select("doc_id", "text_hash", "item_id", F.lit(0).cast("long").alias("n_windows_hit"), n.alias("span"), F.lit(False).alias("same_slots"))
    every = found.unionByName(short.distinct())
    inside = _short_inside(base, slots_of=slots, bench=bench)
    if inside is None:
        return every
    one = ["doc_id", "text_hash", "item_id"]
    return every.unionByName(inside).groupBy(*one).agg(F.max("n_windows_hit").alias("n_windows_hit"), F.max("span").alias("span"), F.bool_or("same_slots").alias("same_slots"))


def _facing(pairs: Column) -> Column:
    """The pairs of slots that face a slot of their kind."""
    return F.filter(pairs, lambda p: p["a"].startswith(MARK) & (F.substring(p["a"], 1, 2) == F.substring(p["b"], 1, 2)))


def _one_to_one(slots: Column) -> Column:
    """Whether distinct pairs of values stand one to one."""
    values = lambda side: F.size(F.array_distinct(F.transform(slots, lambda p: p[side])))
    return (F.size(slots) == values("a")) & (F.size(slots) == values("b"))


def _keys(slots: Column, at: Column, length: Column) -> Column:
    """The two hashes of a window of token arrays ``slots``: its first token plain, the others as a template; and all plain, in one case."""
    window = F.slice(slots, at + 1, length)
    plain = F.transform(window, lambda w: F.regexp_replace(w, f"^{MARK}a", ""))
    template = F.transform(window, lambda w: F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w))
    return F.array(F.xxhash64(F.lit(0), F.get(plain, F.lit(0)), F.slice(template, 2, length)), F.xxhash64(F.lit(1), plain))


def _short_inside(base: DataFrame, slots_of: DataFrame, bench: DataFrame) -> DataFrame | None:
    """Items of fewer than WINDOW tokens, with enough words, inside longer texts; None if the benchmark has none."""
    items = bench.select("item", "item_id", tokens(slot_tokens(F.col("text"))).alias("item_words")).withColumn("length", F.size("item_words"))
    words = F.size(F.filter(F.transform("item_words", lambda w, i: F.when(i == 0, F.regexp_replace(w, f"^{MARK}a", "")).otherwise(w)), lambda w: ~w.startswith(MARK)))
    items = persisted(items.where((F.col("length") < WINDOW) & (words >= LITERAL)).select("item", "item_id", "item_words", "length", F.explode(_keys(F.col("item_words"), F.lit(0), F.col("length"))).alias("h")), "short-items")
    lengths = [r["length"] for r in items.select("length").distinct().collect()]  # at most WINDOW - 1 numbers
    if not lengths:
        return None
    few = items.count() <= MAX_BROADCAST
    texts = slots_of.select("doc_id", "text_hash", tokens(F.col("slots")).alias("words"))
    found = None
    for length in lengths:
        last = F.size("words") - length
        places = F.when(last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), _keys(F.col("words"), i, F.lit(length)).alias("hs"))))
        each = texts.select("doc_id", "text_hash", F.explode_outer(places).alias("x")).where("x IS NOT NULL").select("doc_id", "text_hash", "x.pos", F.explode("x.hs").alias("h"))
        own = items.where(F.col("length") == length)
        hits = each.join(F.broadcast(own) if few else own, "h")
        found = hits if found is None else found.union(hits)
    hits = persisted(found.drop("h").distinct(), "short-hits")
    suspects = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    held = base.join(suspects, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held = held.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), tokens(slot_tokens(F.col("text"))).alias("words"))
    both = hits.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    pairs = F.zip_with("item_words", F.slice("words", F.col("pos") + 1, F.col("length")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # The first word is the same in both, name or not.
    checked = both.withColumn("slots", F.array_distinct(_facing(F.slice(pairs, 2, WINDOW)))).where(_one_to_one(F.col("slots")))
    same = F.forall("slots", lambda p: p["a"] == p["b"])
    return checked.groupBy("doc_id", "text_hash", "item_id").agg(F.lit(0).cast("long").alias("n_windows_hit"), F.max("length").alias("span"), F.bool_or(same).alias("same_slots"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item; same columns."""
    bad_id, bad_hash = unused(docs, "bad_id", "bad_hash")
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_col) == F.col(bad_hash)), "left_anti")
