"""Recordings as tables of ordered samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tables of a folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(events: DataFrame) -> DataFrame:
    """(rec, n, x): event values as the samples of one recording per user, in order of time and id."""
    order = W.partitionBy("rec").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("rec"), "ts", "event_id", F.col("value").alias("x"))
    return rows.select("rec", (F.row_number().over(order) - 1).cast("long").alias("n"), "x")


def flawed(rows: DataFrame) -> DataFrame:
    """Samples with missing values, zeros and a rail, by rule: for tests of the quality operators."""
    x = F.when(F.col("n") % 17 == 3, F.lit(None).cast("double")).when((F.col("n") >= 20) & (F.col("n") < 26), 0.0).otherwise(F.least("x", F.lit(150.0)))
    return rows.select("rec", "n", x.alias("x"))


def window_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, w): vectors as windows of 64 samples."""
    return embeddings.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("w"))


def long_windows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, i, x) of window vectors, i from 0."""
    return vectors.select("vec_id", "label", F.posexplode("w").alias("i", "x"))


def channels_of(frame: DataFrame, time_names: tuple[str, ...] = ("time", "t", "timestamp", "seconds", "sec")) -> list[str]:
    """Numeric columns that are not time columns."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, kind in frame.dtypes if kind.startswith(numeric) and c.lower() not in time_names]


def to_long(frame: DataFrame, index: str, channels: list[str]) -> DataFrame:
    """(channel, n, x): a wide recording unpivoted; reads only the columns asked for."""
    wide = frame.select(F.col(index).cast("long").alias("n"), *(F.col(c).cast("double").alias(c) for c in channels))
    return wide.unpivot("n", channels, "channel", "x").select("channel", "n", "x")


def read_window(long: DataFrame, channels: list[str], start: int, end: int) -> DataFrame:
    """Samples [start, end) of channels: both predicates reach the scan."""
    return long.filter(F.col("channel").isin(channels) & (F.col("n") >= start) & (F.col("n") < end))
