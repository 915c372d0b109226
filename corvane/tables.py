"""Reading the library's tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` kept as Parquet under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a few large row groups would leave half of them idle; else the scan as it is.

    A table with more splits than half the cores is left where it is; one with fewer is small beside the cluster, and its rows,
    texts included, are dealt out once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
