"""What the queries start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments, windows
from ..sources import tables
from .sql import LENGTH, STEP


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(tables.table(spark, sf, "events"))


def grades(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rule_grades(windows.window_stats(samples(spark, sf), LENGTH, STEP))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return segments.run_length_encode(grades(spark, sf), LENGTH)


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Graded windows with artifact tags."""
    tag = lambda on, name: F.when(on, F.lit(name))
    tags = F.array_compact(F.array(tag(F.col("hi") - F.col("lo") > 200, "motion"), tag(F.col("hi") >= 150, "rail"), tag(F.col("sd") < 42, "still")))
    return grades(spark, sf).withColumn("artifacts", tags)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.window_vectors(tables.table(spark, sf, "embeddings"))


def standardized(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, z): windows standardized as the feature packs do."""
    from ..functions.arrays import mean

    rows = vectors(spark, sf).withColumn("m", mean(F.col("w")))
    rows = rows.withColumn("s", F.sqrt(F.greatest(F.lit(0.0), mean(F.transform("w", lambda v: (v - F.col("m")) * (v - F.col("m")))))))
    return rows.select("vec_id", "label", F.transform("w", lambda v: (v - F.col("m")) / (F.col("s") + 1e-8)).alias("z"))


def binary(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    rows = tables.table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y"), F.round(1 - F.exp(-F.col("n_chars") / 2000.0), 3).alias("score"), F.col("source").alias("cluster"), "lang")


def graded_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = tables.table(spark, sf, "labels").join(docs, "doc_id")
    y = F.when(F.col("quality") == 1, 2).otherwise(0) + F.when(F.col("n_chars") > 1500, 1).otherwise(0)
    return rows.select("doc_id", y.alias("y"), F.least(F.lit(3), F.floor(F.col("n_chars") / 1000)).cast("int").alias("p"))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, so that engines that add in another order agree."""
    return frame.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


#: Views that SQL text may name, beside the tables.
VIEWS = {"samples": samples, "grades": grades, "intervals": intervals}


def register(spark: SparkSession, sf: str) -> list[str]:
    """Make the tables of a folder and the engine's views temporary views of the session, so that plain SQL can name them.
    Views are plans: a query over one prunes and pushes down as the DataFrame would."""
    for name in tables.TABLES:
        tables.table(spark, sf, name).createOrReplaceTempView(name)
    for name, view in VIEWS.items():
        view(spark, sf).createOrReplaceTempView(name)
    return [*tables.TABLES, *VIEWS]
