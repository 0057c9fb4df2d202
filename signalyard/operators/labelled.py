"""Labelled windows: spans to samples to windows, and dense tracks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .segments import with_runs


def sample_labels(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """(rec, n, label, kind) of the samples in spans (rec, ord, s, e, label, kind); where spans overlap the last one wins.
    A span is dealt to its samples, so the join is by (recording, sample)."""
    each = spans.withColumn("n", F.explode(F.sequence(F.col("s").cast("long"), (F.col("e") - 1).cast("long"))))
    last = each.groupBy("rec", "n").agg(F.max_by(F.struct("label", "kind"), "ord").alias("l"))
    return samples.join(last, ["rec", "n"]).select("rec", "n", "l.*")


def windowize(samples: DataFrame, spans: DataFrame, length: int, step: int, least: float) -> DataFrame:
    """(rec, start_n, worst, major, burden) of grid windows with labels on at least the share `least` of their samples:
    the worst label, the commonest (of equals the worse), and the share of poor samples among the labelled."""
    total = F.count("*").over(W.partitionBy("rec"))
    labels = sample_labels(samples, spans)
    rows = samples.withColumn("len", total).join(labels, ["rec", "n"])
    first, final = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / step) * step).cast("long"), F.least(F.floor(F.col("n") / step) * step, F.floor((F.col("len") - length) / step) * step).cast("long")
    grid = F.when(first <= final, F.sequence(first, final, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    counts = rows.withColumn("start_n", F.explode(grid)).groupBy("rec", "start_n", "label").agg(F.count("*").alias("n"))
    out = counts.groupBy("rec", "start_n").agg(
        F.min("label").alias("worst"), F.min(F.struct(F.negate("n").alias("k"), "label")).alias("m"),
        (F.sum(F.when(F.col("label").isin("Q0", "Q1"), F.col("n")).otherwise(0)) / F.sum("n")).alias("burden"), F.sum("n").alias("n"),
    )
    return out.filter(F.col("n") >= least * length).select("rec", "start_n", "worst", F.col("m.label").alias("major"), "burden")


#: Greatest shares of a window that may be bad for Q3, Q2 and Q1.
CUTS = (0.05, 0.35, 0.5)


def grade_of_share(share: Column, cuts: Sequence[float] = CUTS) -> Column:
    """The grade, 0 to 3, of a window with this share of bad samples."""
    share = F.round(share, 9)
    return F.when(share <= cuts[0], 3).when(share <= cuts[1], 2).when(share <= cuts[2], 1).otherwise(0)


def window_grades(samples: DataFrame, spans: DataFrame, length: int, step: int, least: float, cuts: Sequence[float] = CUTS) -> DataFrame:
    """(rec, start_n, by_fraction, by_burden, flat) of grid windows with labels on at least the share `least` of their
    samples: the grade of the share of samples that are not Q3, and that of the mean burden (3 - grade) / 3, which is
    never below the worst sample. A window whose values are all equal is Q0 by both."""
    total = F.count("*").over(W.partitionBy("rec"))
    rows = samples.withColumn("len", total).join(sample_labels(samples, spans).select("rec", "n", "label"), ["rec", "n"], "left")
    first, final = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / step) * step).cast("long"), F.least(F.floor(F.col("n") / step) * step, F.floor((F.col("len") - length) / step) * step).cast("long")
    grid = F.when(first <= final, F.sequence(first, final, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    grade = F.substring("label", 2, 1).cast("int")
    out = rows.withColumn("start_n", F.explode(grid)).groupBy("rec", "start_n").agg(
        F.count("label").alias("n"), F.avg((grade < 3).cast("int")).alias("bad"), F.avg((3 - grade) / 3).alias("burden"),
        F.min(grade).alias("worst"), (F.max("x") == F.min("x")).alias("flat"),
    )
    kept = lambda g: F.when(F.col("flat"), 0).otherwise(g)
    out = out.filter((F.col("n") > 0) & (F.col("n") >= least * length))
    return out.select("rec", "start_n", kept(grade_of_share(F.col("bad"), cuts)).alias("by_fraction"), kept(F.greatest(grade_of_share(F.col("burden"), cuts), F.col("worst"))).alias("by_burden"), "flat")


def dense_track(windows: DataFrame, length: int) -> DataFrame:
    """(rec, n, grade): per sample, the first greatest of the class probabilities averaged over the windows that cover it."""
    each = windows.select("rec", F.explode(F.sequence(F.col("start_n"), F.col("start_n") + length - 1)).alias("n"), "probs")
    means = each.groupBy("rec", "n").agg(*(F.avg(F.col("probs")[k]).alias(f"p{k}") for k in range(4)))
    p = F.array(*(F.round(f"p{k}", 9) for k in range(4)))
    return means.select("rec", "n", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("grade"))


def dense_intervals(track: DataFrame, least: int) -> DataFrame:
    """(rec, start_n, end_n, grade): runs of equal grade of at least `least` samples."""
    runs = with_runs(track, order="n", value=("grade",)).groupBy("rec", "run").agg(F.min("n").alias("start_n"), (F.max("n") + 1).alias("end_n"), F.first("grade").alias("grade"))
    return runs.filter(F.col("end_n") - F.col("start_n") >= least).drop("run")


def dense_evaluation(track: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics per sample of a dense track (rec, n, grade) against labels (rec, n, label): the samples that have both."""
    from ..evaluation.metrics import evaluate

    both = track.join(truth, ["rec", "n"])
    return evaluate(both.select(F.substring("label", 2, 1).cast("int").alias("y"), F.col("grade").alias("p")))
