"""Min/max pyramids and envelopes for display, and point look-ups."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FACTORS = (1, 8, 64, 512, 4096)


def pyramid(samples: DataFrame, factors: Sequence[int] = FACTORS) -> DataFrame:
    """(rec, factor, bin, y_min, y_max): each level from the one below; factors beyond the record are left out."""
    finest = samples.withColumn("len", F.count("*").over(W.partitionBy("rec")))
    finest = finest.select("rec", "len", F.col("n").alias("bin"), F.col("x").alias("y_min"), F.col("x").alias("y_max"))
    level, out, below = finest, None, 1
    for f in sorted(factors):
        if f % below:
            level, below = finest, 1
        level = level.filter(F.col("len") >= f)
        if f > below:
            # by recording, as the samples are dealt: no level needs a shuffle of its own
            level = level.groupBy("rec", "len", F.floor(F.col("bin") / (f // below)).alias("bin")).agg(F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
        below = f
        fits = level.select("rec", F.lit(f).alias("factor"), "bin", "y_min", "y_max")
        out = fits if out is None else out.unionByName(fits)
    return out


def select_level(samples_per_pixel: float, factors: Sequence[int] = FACTORS) -> int:
    """The coarsest factor that is no coarser than a pixel; 1, the raw samples, below that."""
    return max([f for f in factors if f <= samples_per_pixel], default=1)


def level_slice(levels: DataFrame, factor: int, start: int, end: int) -> DataFrame:
    """Bins of a level that hold samples [start, end)."""
    return levels.filter((F.col("factor") == factor) & (F.col("bin") >= start // factor) & (F.col("bin") < math.ceil(end / factor)))


def samples_per_bucket(n: int, cap: int) -> int:
    return max(2, math.ceil(n / max(1, cap // 2)))


def envelope(samples: DataFrame, per_bucket: int) -> DataFrame:
    """(rec, n, x): the first least and the first greatest sample of each bucket, in order of time. Values that are not
    finite are picked only where a bucket has no others."""
    ok = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    rows = samples.withColumn("bucket", F.floor(F.col("n") / per_bucket)).withColumn("odd", F.when(ok, 0).otherwise(1))
    point = F.struct("n", "x")
    both = rows.groupBy("rec", "bucket").agg(
        F.min_by(point, F.struct("odd", F.when(ok, F.col("x")).otherwise(0.0), "n")).alias("a"),
        F.min_by(point, F.struct("odd", F.when(ok, -F.col("x")).otherwise(0.0), "n")).alias("b"),
    )
    return both.select("rec", F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("rec", "p.n", "p.x")


def robust_range(samples: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return samples.groupBy("rec").agg(F.percentile("x", F.lit(low)).alias("lo"), F.percentile("x", F.lit(high)).alias("hi"))


def curve_for_range(samples: DataFrame, start: int, end: int, buckets: int = 800) -> DataFrame:
    """The envelope of samples [start, end): the range is cut before anything is grouped."""
    part = samples.filter((F.col("n") >= start) & (F.col("n") < end))
    return envelope(part, max(1, math.ceil((end - start) / buckets)))


def value_at(samples: DataFrame, n: float) -> DataFrame:
    """The sample at n, or the next one; the last one after the end."""
    near = F.struct((F.col("n") < n).alias("before"), F.abs(F.col("n") - n).alias("gap"))
    return samples.groupBy("rec").agg(F.min_by(F.struct("n", "x"), near).alias("s")).select("rec", "s.*")


def view(samples: DataFrame, start: int, end: int, buckets: int, margin: float = 0.12) -> DataFrame:
    """The envelope of what a view of [start, end) shows, and a margin on both sides of it. Buckets are aligned to the
    recording, so that the points of a bucket stay as the view moves."""
    width, more = max(1, math.ceil((end - start) / buckets)), math.ceil(margin * (end - start))
    lo, hi = max(0, start - more) // width * width, -(-(end + more) // width) * width
    return envelope(samples.filter((F.col("n") >= lo) & (F.col("n") < hi)), width)
