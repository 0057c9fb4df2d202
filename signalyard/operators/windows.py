"""Sliding windows that always cover the tail, and what is computed per window.

A sample is dealt to the windows that hold it, so window statistics are one partial aggregation after one shuffle by
recording, whatever the overlap.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TIERS = ("Q0", "Q1", "Q2", "Q3")


def step_of(length: int, overlap: float) -> int:
    """Samples between window starts; halves round to even, and at least one."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return max(1, round(length * (1 - overlap)))


def starts_of(n: Column, length: int, step: int) -> Column:
    """Window starts for a record of n samples: the grid, and the last possible start if the grid leaves a tail."""
    last = n - F.lit(length)
    grid = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))
    return F.when(last >= 0, F.array_distinct(F.concat(grid, F.array(last.cast("long"))))).otherwise(F.array().cast("array<bigint>"))


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rec").agg(F.count("*").alias("len"))


def window_starts(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(rec, start_n); recordings shorter than a window have none, see `not_analysed`."""
    return lengths(samples).select("rec", F.explode(starts_of(F.col("len"), length, step)).alias("start_n"))


def not_analysed(samples: DataFrame, length: int) -> DataFrame:
    """(rec, len, needed): recordings that are too short."""
    return lengths(samples).filter(F.col("len") < length).withColumn("needed", F.lit(length))


def ungraded_tail(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(rec, tail): samples past the last grid window, which the end-anchored window covers."""
    rows = lengths(samples).filter(F.col("len") >= length)
    grid = F.floor((F.col("len") - length) / step) * step + length
    return rows.select("rec", (F.col("len") - grid).cast("long").alias("tail"))


def windowed(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(rec, start_n, pos, x): every sample in every window that holds it."""
    total = F.count("*").over(W.partitionBy("rec"))
    rows = samples.withColumn("len", total).filter(F.col("len") >= length)
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / step) * step).cast("long")
    final = F.least(F.floor(F.col("n") / step) * step, F.floor((F.col("len") - length) / step) * step).cast("long")
    grid = F.when(first <= final, F.sequence(first, final, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = (F.col("len") - length).cast("long")
    holds = F.when((tail % step != 0) & (F.col("n") >= tail), F.array(tail)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("start_n", F.explode(F.concat(grid, holds)))
    return rows.select("rec", "start_n", (F.col("n") - F.col("start_n")).cast("int").alias("pos"), "x")


def window_stats(samples: DataFrame, length: int, step: int) -> DataFrame:
    """(rec, start_n, m, sd, lo, hi) of every window."""
    x = F.col("x")
    return windowed(samples, length, step).groupBy("rec", "start_n").agg(
        F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )


def normalized(windows: DataFrame, how: str = "zscore", column: str = "w") -> DataFrame:
    """Window arrays normalized: none, zscore (population deviation) or minmax; flat windows become zeros."""
    if how == "none":
        return windows
    n = F.size(column)
    add = lambda f: F.aggregate(column, F.lit(0.0), lambda a, v: a + f(v))
    if how == "zscore":
        mid = add(lambda v: v) / n
        wide = F.sqrt(F.greatest(add(lambda v: v * v) / n - mid * mid, F.lit(0.0)))
    elif how == "minmax":
        mid, wide = F.array_min(column), F.array_max(column) - F.array_min(column)
    else:
        raise ValueError(f"unknown normalization {how}")
    rows = windows.withColumn("_mid", mid).withColumn("_wide", wide)
    scaled = F.transform(column, lambda v: F.when(F.col("_wide") > 1e-8, (v - F.col("_mid")) / F.col("_wide")).otherwise(0.0))
    return rows.withColumn(column, scaled).drop("_mid", "_wide")


#: Of the rule grader: relative spread that is typical of each tier, and the width of a tier.
CENTRES, WIDTH = (1.15, 1.02, 0.92, 0.80), 0.15


def rule_grades(stats: DataFrame) -> DataFrame:
    """Window statistics with probs (four tiers), tier, confidence and uncertainty, by a rule on the relative spread.

    This grader is a stand-in of our own for a trained model: the softmax of squared distances to typical spreads.
    """
    cv = F.col("sd") / (F.abs(F.col("m")) + F.lit(1e-9))
    rows = stats.withColumn("e", F.array(*(F.exp(-F.pow((cv - c) / WIDTH, F.lit(2.0))) for c in CENTRES)))
    total = F.aggregate("e", F.lit(1e-12), lambda a, v: a + v)
    rows = rows.withColumn("probs", F.transform("e", lambda v: v / total)).drop("e")
    return graded(rows)


def graded(rows: DataFrame, probs: str = "probs", names: tuple[str, ...] = TIERS) -> DataFrame:
    """Rows with probabilities, given tier (first of the greatest), confidence and normalized entropy."""
    from ..functions.arrays import argmax, confidence, normalized_entropy, sanitize

    rows = rows.withColumn("_bad", ~F.forall(probs, _finite)).withColumn(probs, sanitize(F.col(probs)))
    tier = F.element_at(F.array(*map(F.lit, names)), argmax(F.col(probs)) + 1)
    rows = rows.withColumn("tier", tier).withColumn("confidence", F.when(F.col("_bad"), 0.0).otherwise(confidence(F.col(probs))))
    return rows.withColumn("uncertainty", normalized_entropy(F.col(probs))).drop("_bad")


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def stub_grades(stats: DataFrame) -> DataFrame:
    """A grader for tests: poor at 0.42 if a window exceeds 1.0, else Q3 at 0.91."""
    poor = F.col("hi") > 1.0
    probs = lambda *p: F.array(*map(F.lit, p))
    return graded(stats.withColumn("probs", F.when(poor, probs(0.42, 0.30, 0.18, 0.10)).otherwise(probs(0.03, 0.03, 0.03, 0.91))))


#: Overlaps that settings offer, and the work (samples, doubled by a second pass) from which a record is streamed.
OVERLAPS, STREAMED_FROM = (0.0, 0.25, 0.5, 0.75), 8_000_000


def offered_overlap(overlap: Column) -> Column:
    """The offered overlap nearest to one that was asked for; of equals the smaller."""
    return F.array_min(F.transform(F.array(*map(F.lit, OVERLAPS)), lambda o: F.struct(F.abs(o - overlap).alias("gap"), o.alias("o"))))["o"]


def routed(lengths: DataFrame, recovery: bool = True, threshold: int = STREAMED_FROM) -> DataFrame:
    """`lengths` (rec, len) with work and route: batch, or stream for large records. Both give the same windows."""
    rows = lengths.withColumn("work", F.col("len") * (2 if recovery else 1))
    return rows.withColumn("route", F.when(F.col("work") >= threshold, "stream").otherwise("batch"))


def patches(length: int, tokens: int = 48, overlap: float = 0.5) -> tuple[int, int, int]:
    """(size, step, count) of the patches of a window so that it has about `tokens`."""
    step = max(1, length // tokens)
    size = max(step, round(step / (1 - overlap)))
    return size, step, (length - size) // step + 1
