"""Boundaries of poor intervals, refined on a fine grid of bins.

A bin is bad by its own samples (an excursion, a flat stretch or a rail). Around the bad bins of a poor run the run
stays; its clean flanks are given back, from outside inwards, as long as some window that covers the whole bin was
graded better than what is shown there. Nothing is shown better than a window that covers it was graded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .segments import POOR, rank, with_runs

EPS = 1e-9


def fine_badness(samples: DataFrame, width: int, excess: float = 3.0) -> DataFrame:
    """(rec, b, bad, nb): every whole bin of `width` samples of a recording, and how many there are."""
    whole = W.partitionBy("rec")
    rows = samples.withColumn("med", F.percentile("x", F.lit(0.5)).over(whole)).withColumn("top", F.max(F.abs("x")).over(whole)).withColumn("nb", F.floor(F.count("*").over(whole) / width))
    rows = rows.withColumn("dev", F.abs(F.col("x") - F.col("med")))
    rows = rows.withColumn("scale", F.percentile("dev", F.lit(0.99)).over(whole)).withColumn("b", F.floor(F.col("n") / width)).filter(F.col("b") < F.col("nb"))
    rail = (F.abs("x") > 0.98 * F.when(F.col("top") == 0, 1e-9).otherwise(F.col("top"))).cast("double")
    bins = rows.groupBy("rec", "b", "nb", "scale").agg(F.max("dev").alias("peak"), F.var_pop("x").alias("v"), F.avg(rail).alias("clip"))
    bins = bins.withColumn("usual", F.percentile("v", F.lit(0.5)).over(whole) + 1e-12)
    high = F.col("peak") > excess * F.when(F.col("scale") == 0, 1e-9).otherwise(F.col("scale"))
    return bins.select("rec", "b", "nb", (high | (F.col("v") < 1e-3 * F.col("usual")) | (F.col("clip") > 0.30)).alias("bad"))


def _bins(first: Column, last: Column) -> Column:
    """Numbers of bins from first to last, none if there are none."""
    first, last = first.cast("long"), last.cast("long")
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))


def worst_over(bins: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Bins with the tier and confidence of the worst interval that meets them (the earliest of equals). Intervals are
    dealt to their bins, so the join is by (recording, bin)."""
    met = _bins(F.floor((F.col("start_sec") + EPS) / width), F.ceil((F.col("end_sec") - EPS) / width) - 1)
    each = intervals.select("rec", met.alias("b"), "start_sec", "tier", "confidence")
    found = each.groupBy("rec", "b").agg(F.min_by(F.struct("tier", "confidence"), F.struct(rank(F.col("tier")), "start_sec")).alias("w"))
    return bins.join(found, ["rec", "b"], "left").select(*bins.columns, "w.tier", "w.confidence")


def ceiling_over(bins: DataFrame, windows: DataFrame, length: float, width: float) -> DataFrame:
    """Bins with the tier and confidence of the best window that covers them whole (the earliest of equals)."""
    s = F.col("start_n").cast("double")
    covered = _bins(F.ceil((s - EPS) / width), F.floor((s + length + EPS) / width) - 1)
    each = windows.select("rec", covered.alias("b"), s.alias("s"), F.col("tier").alias("t"), F.col("confidence").alias("c"))
    found = each.groupBy("rec", "b").agg(F.max_by(F.struct("t", "c"), F.struct(rank(F.col("t")), -F.col("s"))).alias("w"))
    return bins.join(found, ["rec", "b"], "left").select(*bins.columns, F.col("w.t").alias("ceil_tier"), F.col("w.c").alias("ceil_conf"))


def refine(intervals: DataFrame, windows: DataFrame, samples: DataFrame, length: float, width: int, margin: int = 1, excess: float = 3.0) -> DataFrame:
    """(rec, start_sec, end_sec, tier, model_tier, confidence): intervals after refinement; model_tier is what a relaxed
    stretch was shown as before, else empty. Recordings where nothing can be relaxed keep their intervals."""
    bins = ceiling_over(worst_over(fine_badness(samples, width, excess), intervals, width), windows, length, width)
    poor = F.coalesce(F.col("tier").isin(*POOR), F.lit(False))
    bins = with_runs(bins.withColumn("poor", poor), order="b", value=("poor",))
    run = W.partitionBy("rec", "run")
    low, high = F.min(F.when(F.col("bad"), F.col("b"))).over(run), F.max(F.when(F.col("bad"), F.col("b"))).over(run)
    bins = bins.withColumn("c0", F.greatest(F.min("b").over(run), low - margin)).withColumn("c1", F.least(F.max("b").over(run), high + margin))
    may = F.coalesce(rank(F.col("ceil_tier")) > rank(F.col("tier")), F.lit(False))
    bins = bins.withColumn("may", may.cast("int"))
    ahead = F.min("may").over(run.orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    behind = F.min("may").over(run.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0))
    bins = bins.withColumn("ahead", ahead).withColumn("behind", behind)
    relaxed = F.col("poor") & F.col("c0").isNotNull() & (((F.col("b") < F.col("c0")) & (F.col("ahead") == 1)) | ((F.col("b") > F.col("c1")) & (F.col("behind") == 1)))
    bins = bins.withColumn("relaxed", F.coalesce(relaxed, F.lit(False)))
    bins = bins.withColumn("model_tier", F.when(F.col("relaxed"), F.col("tier")).otherwise(""))
    bins = bins.withColumn("confidence", F.when(F.col("relaxed"), F.col("ceil_conf")).otherwise(F.col("confidence")))
    bins = bins.withColumn("tier", F.when(F.col("relaxed"), F.col("ceil_tier")).otherwise(F.col("tier")))
    bins = bins.withColumn("changed", F.max("relaxed").over(W.partitionBy("rec")))
    changed = bins.groupBy("rec").agg(F.first("changed").alias("changed"), (F.max("nb") * width).cast("double").alias("grid_end"))
    runs = with_runs(bins.drop("run"), order="b", value=("tier", "model_tier")).filter(F.col("changed") & F.col("tier").isNotNull())
    fine = runs.groupBy("rec", "run").agg((F.min("b") * width).cast("double").alias("start_sec"), ((F.max("b") + 1) * width).cast("double").alias("end_sec"), F.first("tier").alias("tier"), F.first("model_tier").alias("model_tier"), F.avg("confidence").alias("confidence"))
    # what lies past the last whole bin is shown as before, and goes on with the last interval if that is of its tier;
    # recordings without a change are shown as before altogether
    start = F.when(F.col("changed"), F.greatest("start_sec", "grid_end")).otherwise(F.col("start_sec"))
    rest = intervals.join(changed, "rec", "left").withColumn("changed", F.coalesce("changed", F.lit(False))).withColumn("start_sec", start)
    rest = rest.filter(F.col("end_sec") > F.col("start_sec") + EPS).select("rec", "start_sec", "end_sec", "tier", F.lit("").alias("model_tier"), "confidence")
    both = fine.drop("run").unionByName(rest)
    w = W.partitionBy("rec").orderBy("start_sec")
    joins = (F.lag("tier").over(w) == F.col("tier")) & (F.lag("model_tier").over(w) == "") & (F.col("model_tier") == "") & (F.abs(F.lag("end_sec").over(w) - F.col("start_sec")) < EPS)
    both = both.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    one = both.groupBy("rec", "run").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first("tier").alias("tier"), F.first("model_tier").alias("model_tier"), F.min_by("confidence", "start_sec").alias("confidence"))
    return one.drop("run")
