"""Line dedup over a log-template tree, in DataFrame functions alone.

Every line goes down a tree of fixed depth: first its token count, then its leading ``depth`` tokens.
Tokens with a digit are the wildcard ``<*>`` from the start. A leaf turns the fields that vary into
wildcards: a token stays in the template if ``min_docs`` independent documents or more have it at its
place in the leaf, so lines that agree in all but a name have one template, whatever their length and
wherever the name stands. A template is worth its name if ``min_tokens`` of its tokens and a
``similarity`` share of them are constant; a line whose field holds a common value also belongs to the
template with that field generalised, if the leaf has it.

A template recurs if it stands in ``min_docs`` independent documents or more; lines of recurring
templates are dropped from all documents. So are lines that recur as they stand; of these, lines of
fewer than ``min_tokens`` tokens need twice as many documents for each token they lack. Near copies
(``copy_groups``: half of the longer one's tokens shared, line by line) are one document, so copies do
not make a template: near-duplicate search deals with them. Lines of up to ``min_tokens`` tokens are
not generalised, but for digits.

Counts are summed before each shuffle, so a line that stands in a third of the documents is counted
by all tasks. Null texts stay null; blank lines stay; a document may end up empty but keeps its row.
Repeated rows are one document. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import components_by_keys, persisted, unused

#: A token that holds a digit, from its first character on.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
N_LINES, N_DROPPED = "__n_lines", "__n_dropped"


TOKEN = r"[^\x20\x09-\x0D]"
#: Lines without any of these are their own shape.
TO_MASK = r"[0-9\x09\x0B-\x0D]|\x20\x20|^\x20|\x20$"


def line_shape(line: Column) -> Column:
    """The line with variable tokens masked and white space made single."""
    masked = F.trim(F.regexp_replace(F.regexp_replace(line, VARIABLE, "<*>"), r"[\x20\x09\x0B-\x0D]+", " "))
    return F.when(line.rlike(TO_MASK), masked).otherwise(line)


def n_tokens(shape: Column) -> Column:
    return F.when(shape == "", 0).otherwise(F.length(shape) - F.length(F.replace(shape, F.lit(" "), F.lit(""))) + 1)


def template_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """One row per line with a token: (id, text_hash, line, shape, leaf, masked).

    ``shape`` is a hash with the number of tokens in the low byte; ``leaf`` and the masked line are null for
    lines too short to generalise. Lines are exploded first, so that all else is compiled code over columns.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode_outer(F.split(F.col(text_col), "\n", -1)).alias("line", "raw"))
    lines = lines.where(F.col("raw").rlike(TOKEN)).select("id", "text_hash", "line", line_shape(F.col("raw")).alias("s"))
    lines = lines.select("id", "text_hash", "line", "s", n_tokens(F.col("s")).alias("n"))
    shape = F.shiftleft(F.xxhash64("n", "s"), 8).bitwiseOR(F.least("n", F.lit(255)).cast("long"))
    long = F.col("n") > min_tokens
    return lines.select("id", "text_hash", "line", shape.alias("shape"), F.when(long, F.xxhash64("n", F.substring_index("s", " ", depth))).alias("leaf"), F.when(long, F.col("s")).alias("masked"))


def leaf_lines(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(shape, leaf, masked) of the distinct shapes in ``leaves``."""
    rows = lines.where("leaf IS NOT NULL").select("shape", "leaf", "masked").join(leaves, "leaf", "left_semi")
    return rows.groupBy("shape").agg(F.first("leaf").alias("leaf"), F.first("masked").alias("masked"))


def leaf_templates(distinct: DataFrame, held: DataFrame, min_docs: int, min_tokens: int, similarity: float, depth: int) -> DataFrame:
    """The shapes (one column) that belong to a recurring template of their leaf."""
    documents = F.count_distinct("root")
    words = distinct.select("shape", "leaf", F.posexplode_outer(F.split("masked", " ")).alias("pos", "token"))
    words = persisted(words.select("shape", "leaf", "pos", F.xxhash64("token").alias("token")), "leaf-words")
    # All of a reached leaf have its leading tokens: they are constant without a count.
    leading, words = words.where(F.col("pos") < depth), words.where(F.col("pos") >= depth)
    constant = words.join(held.select("shape", "root"), "shape").groupBy("leaf", "pos", "token").agg(documents.alias("n")).where(F.col("n") >= min_docs)
    constant = persisted(constant.select("leaf", "pos", "token", F.xxhash64("pos", "token").alias("field")), "leaf-constants")
    of_shape = words.join(constant, ["leaf", "pos", "token"], "left").select("shape", "leaf", "field")
    of_shape = of_shape.union(leading.select("shape", "leaf", F.xxhash64("pos", "token").alias("field")))
    # The fields' hashes combined by exclusive or: leaving out one of them takes its hash away again.
    of_shape = of_shape.groupBy("shape", "leaf").agg(F.count(F.lit(1)).alias("n"), F.count("field").alias("n_constant"), F.bit_xor("field").alias("fields"), F.collect_list("field").alias("each"))
    of_shape = persisted(of_shape.where("n_constant > 0"), "shape-templates")
    named = of_shape.where((F.col("n_constant") >= min_tokens) & (F.col("n_constant") >= similarity * F.col("n")))
    named = named.select("shape", F.xxhash64("leaf", "n_constant", "fields").alias("template"))
    often = named.join(held.select("shape", "root"), "shape").groupBy("template").agg(documents.alias("n_docs")).where(F.col("n_docs") >= min_docs)
    often = persisted(often.select("template"), "leaf-templates")
    wider = of_shape.select("shape", "leaf", "n_constant", "fields", F.explode("each").alias("field"))
    wider = wider.select("shape", F.xxhash64("leaf", F.col("n_constant") - 1, F.col("fields").bitwiseXOR(F.col("field"))).alias("template"))
    return named.union(wider).join(often, "template", "left_semi").select("shape")


def copy_groups(sets: DataFrame, shared: float) -> DataFrame:
    """(node, root) of the nodes that have near copies: documents that share ``shared`` or more of the longer one's tokens, line by line, or are connected by such.

    All such pairs are found. A document's lines are ordered, the rarest first. The rarest line that two near copies
    have in common is followed, in both, by all others they have in common, so it stands where ``shared`` of
    the document's tokens are still to come. Only these lines are keys. A line that many documents have so is
    narrowed: the next line in common stands where the tokens that are still wanted are yet to come.
    Documents whose lines so far are enough are near copies of each other without more.
    """
    weight = F.col("shape").bitwiseAND(0xFF)
    each = sets.select("node", F.aggregate("set", F.lit(0).cast("long"), lambda n, t: n + t.bitwiseAND(0xFF)).alias("size"), F.explode("set").alias("shape"))
    often = each.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ahead = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shape")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = each.join(often, "shape").select("node", "size", "n", "shape", weight.alias("tokens"), F.sum(weight).over(ahead).alias("rest"))
    rows = persisted(rows, "common-lines")
    first = rows.where(F.col("rest") >= shared * F.col("size"))
    keys = first.select(F.col("shape").alias("key"), "node", "size", F.col("tokens").alias("got"), F.struct("n", "shape").alias("last"))
    token_sum = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, t: n + t.bitwiseAND(0xFF))
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        longer = F.greatest(token_sum(F.col("set_a")), token_sum(F.col("set_b")))
        return pairs.join(a, "a").join(b, "b").where(token_sum(F.array_intersect("set_a", "set_b")) >= shared * longer).select("a", "b")

    def narrower(common: DataFrame) -> DataFrame:
        more = rows.select("node", F.struct("n", "shape").alias("next"), "tokens", "rest")
        both = common.join(more, "node").where((F.col("next") > F.col("last")) & (F.col("rest") >= shared * F.col("size") - F.col("got")))
        return both.select(F.xxhash64("key", "next.shape").alias("key"), "node", "size", (F.col("got") + F.col("tokens")).alias("got"), F.col("next").alias("last"))

    found = components_by_keys(keys, verified, narrower, lambda k: k.where(F.col("got") >= shared * F.col("size")), name="line-copies")
    return found.withColumnRenamed("component", "root")


def recurring_shapes(lines: DataFrame, min_docs: int, min_tokens: int, similarity: float, shared: float, depth: int) -> DataFrame:
    """(shape) of all lines to drop; ``lines`` as ``template_lines`` gives them."""
    of_docs = lines.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("shape", "leaf"))).alias("both"))
    sets = of_docs.select(F.transform("both", lambda x: x["shape"]).alias("set"), F.transform("both", lambda x: x["leaf"]).alias("leaves"))
    sets = persisted(sets.select(F.xxhash64("set").alias("node"), "set", "leaves").dropDuplicates(["node"]), "template-sets")
    roots = copy_groups(sets.select("node", "set"), shared)
    held = sets.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.explode(F.arrays_zip("set", "leaves")).alias("x"))
    held = persisted(held.select("root", F.col("x.set").alias("shape"), F.col("x.leaves").alias("leaf")).distinct(), "shapes-of-documents")
    lacking = F.greatest(F.lit(min_tokens) - F.col("shape").bitwiseAND(0xFF), F.lit(0))
    exact = held.groupBy("shape").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs * F.pow(F.lit(2.0), lacking)).select("shape")
    # Only a leaf that enough documents reach can hold a template.
    leaves = held.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count_distinct("root").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    leaves = persisted(leaves.select("leaf"), "reached-leaves")
    distinct = persisted(leaf_lines(lines, leaves), "leaf-lines")
    return exact.union(leaf_templates(distinct, held, min_docs, min_tokens, similarity, depth)).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_tokens: int = 4, depth: int = 2, similarity: float = 0.75, shared: float = 0.5) -> DataFrame:
    """``docs`` without the lines of recurring templates, and the columns ``__n_lines`` and ``__n_dropped`` (in place of any of these names)."""
    if not 0 < depth <= min_tokens:
        raise ValueError("a template's leading tokens are among its constant ones")
    lines = persisted(template_lines(docs, id_col, text_col, depth, min_tokens), "template-lines")
    drop = persisted(recurring_shapes(lines, min_docs, min_tokens, similarity, shared, depth), "recurring-shapes")
    gone, hit_id, hit_hash, split = unused(docs, "drop", "hit_id", "hit_hash", "lines")
    hits = lines.join(drop, "shape").groupBy("id", "text_hash").agg(F.collect_set("line").alias(gone))
    hits = hits.select(F.col("id").alias(hit_id), F.col("text_hash").alias(hit_hash), gone)
    found = docs.join(hits, F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(text_col) == F.col(hit_hash)), "left")
    text = F.col(text_col)
    # A column of its own, used twice: Spark then splits once and not once a line.
    found = found.withColumn(split, F.split(text, "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    counted = found.withColumn(N_LINES, n_lines).withColumn(N_DROPPED, n_dropped)
    return counted.withColumn(text_col, cleaned).drop(hit_id, hit_hash, gone, split)
