"""What the operators share: reading a table, cutting lineage, ranking without one-task windows, components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.scratch import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hands texts to Python tasks in batches of ``rows``: they are long, and Spark's default of 10,000 rows takes much memory for them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persisted(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_rank(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds ``out``: a gapless 0-based rank within ``group``, without a window over a whole group.

    Rows are dealt into ``buckets`` by a hash of ``order``; each (group, bucket) is ranked alone and
    the counts of the buckets before it are added. A group holding most rows is thus ranked by many
    tasks. ``df`` is evaluated twice: pass a persisted one. Rows equal in ``order`` get different
    ranks, in any order.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_gb")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(counts, same).withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_gb", "_before", *[f"_g{i}" for i in range(len(group))])


def _stars(edges: DataFrame) -> bool:
    """Whether no u of the distinct rows (u, v) has two v or is itself one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    counts = ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return counts.where("ups > 0 AND n > 1").isEmpty()


def star_links(links: DataFrame, a: str, b: str, name: str = "components", written: bool = False, rows_a_file: int = 100_000) -> DataFrame:
    """Rows (node, component) of all nodes of ``links`` but the smallest of each connected component, which is its name.

    Alternates large-star and small-star steps until every node has one link at most to a smaller one, and this
    none further. The links stay in Spark all along; each step is written to the shared folder, in files of
    ``rows_a_file`` links or one a core, so that Spark sees how small few links are and broadcasts them itself. Links to oneself and
    repeated links do no harm; ``written`` links are read as they are, and so are not written again at first.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if not written:
        edges = persisted(edges.distinct(), name)
    cores = links.sparkSession.sparkContext.defaultParallelism
    n, first = edges.count(), True
    while n and (first or not _stars(edges)):
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = persisted(small.coalesce(max(cores, -(-n // rows_a_file))), name)
        n, first = edges.count(), False
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_centres(stars: DataFrame) -> DataFrame:
    """The rows of ``star_links`` and those of the smallest nodes themselves."""
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components of ``links``: rows (node, component), component = smallest reachable node; nodes without any link are not returned."""
    return with_centres(star_links(links, a, b, name))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``df`` has such a column already. Column names differ without regard to case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def star_pairs(rows: DataFrame, whole: int = 0, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of nodes that share a key, from distinct rows (node, key), and the keys of more than ``whole`` nodes.

    Keys of up to ``whole`` nodes give all their pairs, others at most two a row: a key's nodes are dealt into
    ``buckets``; each meets one node of its bucket, and these meet one of their own. Which node it is differs
    from key to key. So no task holds all of a common key, and nodes of which every two are alike are
    connected by any key that only they share.
    """
    given = rows
    rows = rows.select("key", "node", F.struct(F.xxhash64("key", "node").alias("h"), F.col("node").alias("node")).alias("x"), F.pmod("node", F.lit(buckets)).alias("bucket"))
    centres = rows.groupBy("key", "bucket").agg(F.min("x").alias("centre"), F.count(F.lit(1)).alias("n"))
    tops = centres.groupBy("key").agg(F.min("centre").alias("top"), F.sum("n").alias("n")).where("n > 1")
    tops = persisted(tops, "star-keys")
    large = tops.where(F.col("n") > whole).select("key", "top")
    centres = persisted(centres.join(large, "key").select("key", "bucket", F.col("centre.node").alias("centre"), F.col("top.node").alias("top"), "n"), "star-centres")
    within = rows.join(centres.where("n > 1"), ["key", "bucket"]).select("node", F.col("centre").alias("other"))
    pairs = within.union(centres.select(F.col("centre").alias("node"), F.col("top").alias("other")))
    if whole > 1:
        few = given.join(tops.where(F.col("n") <= whole).select("key"), "key").groupBy("key").agg(F.collect_list("node").alias("all"))
        few = few.select("all", F.explode("all").alias("node"))
        pairs = pairs.union(few.select("node", F.explode(F.filter("all", lambda x: x > F.col("node"))).alias("other")))
    return pairs.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), large.select("key")


def components_by_keys(keys: DataFrame, verified: Callable[[DataFrame], DataFrame], narrower: Callable[[DataFrame], DataFrame], sure: Callable[[DataFrame], DataFrame] | None = None, whole: int = 64, name: str = "links") -> DataFrame:
    """Connected components (node, component) of the nodes that are alike and share keys, without all pairs of a common key.

    ``keys`` has distinct rows (key, node, ...). A key of up to ``whole`` nodes proposes all its pairs, a larger
    one a star. ``verified`` keeps the pairs that are alike. A larger key whose nodes are connected by then is done;
    the rows of any other go through ``narrower``, which must give every two alike nodes of a key a common
    narrower key (and none once a row has no more to narrow by), and all begins again with these; the links found
    by then go on as the stars of their components. ``sure`` picks the rows of ``keys`` of which any two with one key
    are alike: they get a star of their own.
    """
    stars = None
    while True:
        rows = keys.select("key", "node")
        if sure is not None:
            rows = rows.union(sure(keys).select(F.xxhash64("key", F.lit("sure")).alias("key"), "node"))
        pairs, large = star_pairs(rows, whole)
        links = persisted(verified(persisted(pairs, f"{name}-pairs")), name)
        stars = star_links(links if stars is None else stars.toDF("b", "a").select("a", "b").union(links), "a", "b", f"{name}-so-far", written=True)
        roots = with_centres(stars)
        common = keys.join(large, "key", "left_semi")
        if common.isEmpty():
            return roots
        rooted = common.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("component", "node").alias("root"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        keys = persisted(narrower(common.join(apart, "key", "left_semi")), f"{name}-keys")
        if keys.isEmpty():
            return roots
