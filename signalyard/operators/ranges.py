"""Order without a single task: ranges of a key, and running sums over them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bucket_count(spark: SparkSession, least: int = 64) -> int:
    """Buckets for a range-wise step: twice the shuffle partitions, which a cluster sets by the size of its input."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_buckets(df: DataFrame, key: str, buckets: int, spread: Column | None = None) -> tuple[Column, list]:
    """A bucket number by ranges of a numeric key, and the keys at which buckets begin. Null keys come first: in bucket -1,
    or dealt to `buckets` of them by `spread`, a number from 0 to 1 by which they are in order.

    The bounds are approximate quantiles: at most `buckets` numbers, whatever the size of `df`. A key is looked up in
    every k-th bound and then in the k that follow.
    """
    ranks = [(i + 1) / buckets for i in range(buckets - 1)]
    found = df.select(F.percentile_approx(key, ranks, 20 * buckets).alias("q")).first()["q"] if ranks else None
    bounds = sorted(set(found or []))
    none = F.lit(-1) if spread is None else F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(spread * buckets).cast("int"))) - buckets
    if not bounds:
        return F.when(F.col(key).isNull(), none).otherwise(F.lit(0)), bounds
    k = max(1, round(len(bounds) ** 0.5))
    every, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[k - 1 :: k]))
    steps = F.size(F.filter(coarse, lambda b: b < F.col(key))) * k
    rest = F.size(F.filter(F.slice(every, steps + 1, F.lit(k)), lambda b: b < F.col(key)))
    return F.when(F.col(key).isNull(), none).otherwise(steps + rest), bounds


def running_sums(df: DataFrame, key: str, values: dict[str, str], ties: list[str], buckets: int | None = None, spread: Column | None = None) -> DataFrame:
    """`df` with a column for each of `values` (name: column to sum): the sum over all rows before, in order of key and
    ties. `spread` deals null keys to buckets, see `range_buckets`; it must ascend with the ties.

    Rows are ordered within range buckets only; one sum per bucket goes to the driver.
    """
    bucket, _ = range_buckets(df, key, buckets or bucket_count(df.sparkSession), spread)
    dealt = df.withColumn("_bucket", bucket.cast("int"))
    sums = sorted(tuple(r) for r in dealt.groupBy("_bucket").agg(*(F.sum(v) for v in values.values())).collect())
    starts, so_far = [], [0] * len(values)
    for b, *more in sums:
        starts.append((b, *so_far))
        so_far = [x + (y or 0) for x, y in zip(so_far, more, strict=True)]
    begin = [f"_start{i}" for i in range(len(values))]
    starts = df.sparkSession.createDataFrame(starts, "_at int, " + ", ".join(f"{c} long" for c in begin))
    dealt = dealt.join(F.broadcast(starts), F.col("_bucket") == F.col("_at"))  # a row per bucket
    inside = W.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *ties).rowsBetween(W.unboundedPreceding, -1)
    for i, (name, value) in enumerate(values.items()):
        dealt = dealt.withColumn(name, F.col(begin[i]) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return dealt.drop("_at", *begin)
