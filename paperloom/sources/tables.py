"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.scratch import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer partitions than the cluster has cores to all cores: a small table in one file is else read by one task. Larger tables are left as they are, with no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder as Parquet and read back, where several passes follow."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
