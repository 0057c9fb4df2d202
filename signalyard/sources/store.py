"""The engine's own store: samples and pyramid levels as partitioned Parquet."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str, block: int = 1_000_000) -> None:
    """Samples (rec, channel, n, x) by recording and channel, sorted by n, so that ranges prune row groups."""
    rows = samples.withColumn("block", F.floor(F.col("n") / block))
    rows = rows.repartition("rec", "channel", "block").sortWithinPartitions("rec", "channel", "n")
    rows.select("rec", "channel", "n", F.col("x").cast("float").alias("x")).write.partitionBy("rec", "channel").parquet(path)


def read_samples(spark: SparkSession, path: str, rec, channels: list[str], start: int, end: int) -> DataFrame:
    rows = spark.read.parquet(path).filter((F.col("rec") == rec) & F.col("channel").isin(channels))
    return rows.filter((F.col("n") >= start) & (F.col("n") < end))


def write_levels(levels: DataFrame, path: str) -> None:
    levels.write.partitionBy("factor").parquet(path)


def read_level(spark: SparkSession, path: str, factor: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("factor") == factor)
