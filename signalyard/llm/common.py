"""What the training-data operators share: text as bytes, code shipping, and tables in the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import bucket_count, range_buckets, running_sums
from ..runtime import drop_written, new_path, shared_folder, ship, written

__all__ = ["bucket_count", "drop_written", "load", "new_path", "prepare", "range_buckets", "running_sums", "shared_folder", "text_bytes", "written"]

#: Rows that go to a Python worker at once. Texts may be long, so this is far below Spark's 10,000.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Make the package importable on every executor and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty: Python workers then need not decode it."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
