"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of a text is a blob named by its SHA-256. Only pairs of blob and rule version that the
ledger does not hold are scanned; findings are kept per blob and joined back to all rows (paths,
versions) that hold it. A rerun with the same rules scans new blobs alone; a changed rule has a new
version, derived from the patterns, and scans all blobs once more.

Matches are found by marking: a pattern's matches are wrapped in two control characters, and the text is
cut at the first of them. Each part is then a match and what follows it, and running sums of the parts'
lengths give every match's place in code points, in time linear in the matches. (Where a text holds
these control characters itself, a third one stands for them, which no pattern tells apart.)

Kinds: ``assign``, ``access`` and ``hex`` are the base rules; ``pem`` (private key blocks; the first line alone
if the last is missing or more than eight hyphens stand between them), ``jwt``, ``github``, ``slack`` and ``url``
(credentials in an address, of any length) are added to them. Null texts are empty
and have no finding. Repeated rows share a blob and each get its findings; a null id keeps its row.
Extra columns are ignored. A blob's findings are one array, as long as its text has matches.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import persisted

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
#: Kinds in their order, as Java patterns. A run of hexadecimal digits matches whole or not at all, and so
#: does what follows AKIA: asking for the least length is the same as dropping shorter matches. A short
#: value of ``assign`` does take its place, so it is matched first and dropped after.
PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----)?",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "url": r"(?<![a-z0-9+.-])([0-9+.-]*+)([a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D:@/]+:[^\x20\x09-\x0D:@/]+@)",
}
#: What of a match is wrapped. A scheme begins with the first letter of its run; asking for the whole run
#: keeps the search linear, and what stands before that letter is left outside.
_WRAPPED = {"url": f"$1{_OPEN}$2{_CLOSE}"}
BASE = ("assign", "access", "hex")
MIN_VALUE = 12
_VALUE = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)$"""


#: Names the rules: it changes with any of them.
RULE_VERSION = hashlib.sha256(repr((PATTERNS, BASE, MIN_VALUE, _VALUE)).encode()).hexdigest()[:16]
_FOUND = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matched_parts(text: Column, rank: int, kind: str) -> Column:
    """Array of (rank, i, length, match_length, good): part i of the text cut before every match; part 0 has no match. Null where nothing matches."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], _WRAPPED.get(kind, f"{_OPEN}$0{_CLOSE}")), _OPEN, -1)

    def part(x: Column, i: Column) -> Column:
        match = F.substring_index(x, _CLOSE, 1)
        good = F.length(F.regexp_extract(match, _VALUE, 1)) >= MIN_VALUE if kind == "assign" else F.lit(True)
        marks = F.when(i > 0, 1).otherwise(0)
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), (F.length(x) - marks).cast("long").alias("length"), F.when(i > 0, F.length(match)).cast("long").alias("match_length"), (good & (i > 0)).alias("good"))

    return F.when(text.rlike(PATTERNS[kind]), F.transform(parts, part))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, found) of the blobs (blob, text) with findings: spans as structs (start, rank, kind, end), sorted."""
    text = F.col("text")
    plain = F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    # A blob whose row is repeated, id and all, comes more than once; each copy is placed for itself.
    each = blobs.select("blob", F.monotonically_increasing_id().alias("copy"), plain.alias("text"))
    each = each.select("blob", "copy", *[matched_parts(F.col("text"), rank, kind).alias(kind) for rank, kind in enumerate(PATTERNS)])
    some = F.flatten(F.array_compact(F.array(*PATTERNS)))
    rows = each.select("blob", "copy", F.explode_outer(some).alias("x")).where("x IS NOT NULL").select("blob", "copy", "x.*").repartition("blob")
    before = Window.partitionBy("blob", "copy", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).where("good")
    kind = F.get(F.array(*map(F.lit, PATTERNS)), F.col("rank"))
    span = F.struct("start", "rank", kind.alias("kind"), (F.col("start") + F.col("match_length")).alias("end"))
    found = placed.groupBy("blob", "copy").agg(F.array_sort(F.collect_list(span)).alias("found"))
    return found.groupBy("blob").agg(F.first("found").alias("found"))


def with_blob(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.withColumn("blob", F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)))


def scan_versions(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of the blobs not yet in the ledger, the ledger's new rows).

    ``ledger`` has (blob, rule_version, found), one row for each scanned pair; found is null where
    there is nothing. Append the new rows to it.
    """
    named = with_blob(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    # One row of each blob is scanned: the one with the smallest id. The blob and the id deal the rows, so
    # copies go to many tasks.
    reps = named.groupBy("blob").agg(F.min("id").alias("rep"))
    if ledger is not None:
        reps = reps.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    reps = persisted(reps.withColumnRenamed("blob", "rep_blob"), "unseen-blobs")
    chosen = named.join(reps, (named["blob"] == reps["rep_blob"]) & named["id"].eqNullSafe(reps["rep"]), "left_semi")
    found = persisted(scan(chosen.select("blob", "text")), "secret-findings")
    new = reps.select(F.col("rep_blob").alias("blob"), F.lit(rule_version).alias("rule_version")).join(found, "blob", "left")
    return found, new


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None where there is none yet."""
    try:
        return spark.read.schema(f"blob binary, rule_version string, found {_FOUND}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(rows: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans what the ledger at ``path`` has not seen, appends it there and returns the whole ledger."""
    _, new = scan_versions(rows, id_col, text_col, read_ledger(rows.sparkSession, path), rule_version)
    new.write.mode("append").parquet(path)
    return read_ledger(rows.sparkSession, path)


def known(ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, found) of one rule version, each blob once even if two runs appended it."""
    return ledger.where((F.col("rule_version") == rule_version) & F.col("found").isNotNull()).select("blob", "found").dropDuplicates(["blob"])


def findings(rows: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``rows``: doc_id, counts, base_sha256, spans; ``found`` has (blob, found)."""
    named = with_blob(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "blob")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    all_rows = named.join(found, "blob", "left").withColumn("found", F.coalesce("found", none))

    def joined(kinds: Column) -> Column:
        return F.array_join(F.transform(kinds, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return all_rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
