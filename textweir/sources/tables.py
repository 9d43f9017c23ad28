"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; one with fewer scan tasks than cores (a few small files) is dealt out, so that the work that
    follows uses all cores. Tables with enough files or row groups are read as they are, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
