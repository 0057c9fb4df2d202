"""Metrics of graders as aggregates.

Grades are integers 0..k-1 against a fixed grid of labels. Scores are ordered once per metric by distinct value, so a
metric needs one shuffle by score and a running sum over the distinct scores.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranges import running_sums
from ..runtime import written


def confusion(rows: DataFrame, labels: Sequence[int] = (0, 1, 2, 3), y: str = "y", p: str = "p") -> DataFrame:
    """(y, p, n) for every pair of labels; values outside the labels are not counted."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y int, p int")
    counts = rows.filter(F.col(y).isin(*labels) & F.col(p).isin(*labels)).groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["y", "p"], "left").fillna(0, ["n"])


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def per_class(cm: DataFrame) -> DataFrame:
    """(label, precision, recall, specificity, f1, support) from a confusion table."""
    each = cm.select(F.explode(F.array_distinct(F.array("y", "p"))).alias("label"), "y", "p", "n")
    hit = F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0))
    row = F.sum(F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0))
    col = F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0))
    sums = each.groupBy("label").agg(hit.alias("tp"), row.alias("support"), col.alias("called"))
    total = F.sum("support").over(W.partitionBy())
    sums = sums.withColumn("total", total)
    precision, recall = _share(F.col("tp"), F.col("called")), _share(F.col("tp"), F.col("support"))
    tn = F.col("total") - F.col("support") - F.col("called") + F.col("tp")
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), _share(tn, F.col("total") - F.col("support")).alias("specificity"), f1.alias("f1"), "support")


def evaluate(rows: DataFrame, labels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """One row: accuracy, balanced accuracy over labels that occur, macro and weighted F1, kappa, linear and quadratic
    weighted kappa."""
    cm = confusion(rows, labels)
    k = len(labels)
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("y")), F.array_position(F.array(*map(F.lit, labels)), F.col("p"))
    gap = F.abs(place[0] - place[1])
    margins = cm.withColumn("r", F.sum("n").over(W.partitionBy("y"))).withColumn("c", F.sum("n").over(W.partitionBy("p"))).withColumn("t", F.sum("n").over(W.partitionBy()))
    expect = F.col("r") * F.col("c") / F.col("t")

    def kappa(weight: Column) -> Column:
        seen, chance = F.sum(weight * F.col("n")), F.sum(weight * expect)
        return F.when(chance == 0, 0.0).otherwise(1 - seen / chance)

    one = margins.agg(
        (F.sum(F.when(gap == 0, F.col("n")).otherwise(0)) / F.max("t")).alias("accuracy"),
        kappa(F.when(gap == 0, 0.0).otherwise(1.0)).alias("kappa"),
        kappa(gap / (k - 1)).alias("linear_kappa"),
        kappa(gap * gap / (k - 1) ** 2).alias("qwk"),
    )
    stats = per_class(cm).agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    return one.crossJoin(stats)  # one row each


def _steps(rows: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Distinct scores with positives and negatives at and above each. Scores are ordered within ranges, each a task."""
    by = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).cast("long").alias("pos"), (F.count("*") - F.sum(y)).cast("long").alias("neg"))
    by = written(by.withColumn("_down", -F.col("score")), "scores")
    p, n = by.agg(F.sum("pos"), F.sum("neg")).first()
    sums = running_sums(by, "_down", {"tp": "pos", "fp": "neg"}, [])
    return sums.select("score", "pos", "neg", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("fp") + F.col("neg")).alias("fp"), F.lit(p).cast("long").alias("P"), F.lit(n).cast("long").alias("N"))


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counting half; null for a single class."""
    area = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0))
    return _steps(rows).agg(F.when((F.max("P") > 0) & (F.max("N") > 0), area / (F.max("P") * F.max("N"))).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise average precision, and its chance level, the share of positives; null for a single class."""
    both = (F.max("P") > 0) & (F.max("N") > 0)
    area = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return _steps(rows).agg(F.when(both, area / F.max("P")).alias("ap"), (F.max("P") / (F.max("P") + F.max("N"))).alias("chance"))


def sensitivity_at_specificity(rows: DataFrame, targets: Sequence[float] = (0.95, 0.97, 0.99)) -> DataFrame:
    """(target, sensitivity, specificity, threshold): the greatest sensitivity at a specificity of the target at least;
    of equals the most specific one. Calling nothing positive always qualifies."""
    points = _steps(rows).select("score", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))
    start = rows.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "score double, tpr double, fpr double")
    points = points.unionByName(start).withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    fits = points.filter(1 - F.col("fpr") >= F.col("target"))
    best = fits.groupBy("target").agg(F.max_by(F.struct("tpr", "fpr", "score"), F.struct("tpr", F.negate("fpr"))).alias("b"))
    return best.select("target", F.col("b.tpr").alias("sensitivity"), (1 - F.col("b.fpr")).alias("specificity"), F.col("b.score").alias("threshold"))


def proper_scores(rows: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(nll, brier) of probabilities of the positive class."""
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    nll = F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p)))
    return rows.agg(nll.alias("nll"), F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier"))


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, count, mean_score, mean_true) of equal-width bins closed on the right; empty bins are left out."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("score") * bins) - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.avg("y").alias("mean_true"))


def expected_calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    return reliability(rows, bins).agg((F.sum(F.col("count") * F.abs(F.col("mean_score") - F.col("mean_true"))) / F.sum("count")).alias("ece"))


def decision_rates(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates of the decision score >= threshold; null where a class does not occur."""
    yes = (F.col("score") >= threshold).cast("double")
    usable = F.avg(F.when(F.col("y") == 1, yes))
    wrong = F.avg(F.when(F.col("y") == 0, yes))
    return rows.agg(wrong.alias("false_usable"), (1 - usable).alias("false_unusable"), usable.alias("usable_recall"), (1 - wrong).alias("unusable_recall"), ((usable + 1 - wrong) / 2).alias("balanced"))


def coverage_risk(rows: DataFrame, coverages: Sequence[float] = (0.5, 0.7, 0.9, 1.0)) -> DataFrame:
    """(target, coverage, retained_false_usable): the best-scored share, with all ties of the last score kept."""
    steps = _steps(rows).select((F.col("tp") + F.col("fp")).alias("kept"), "fp", (F.col("P") + F.col("N")).alias("n"))
    each = steps.withColumn("target", F.explode(F.array(*map(F.lit, coverages))))
    enough = each.filter(F.col("kept") >= F.ceil(F.col("target") * F.col("n")))
    best = enough.groupBy("target").agg(F.min(F.struct("kept", "fp", "n")).alias("b"))
    return best.select("target", (F.col("b.kept") / F.col("b.n")).alias("coverage"), (F.col("b.fp") / F.col("b.kept")).alias("retained_false_usable"))


def overlap_accuracy(rows: DataFrame, tolerance: int = 1) -> DataFrame:
    return rows.agg(F.avg((F.abs(F.col("y") - F.col("p")) <= tolerance).cast("double")).alias("overlap_accuracy"))


def summarize(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, std, n) over runs; NaN and null are dropped; the deviation of one run is 0."""
    rows = runs.filter(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count("*")
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value)).otherwise(0.0).alias("std"), n.alias("n"))


def binary_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of discrimination, calibration and decision metrics; every part is a single row."""
    out = auroc(rows)
    for part in (average_precision(rows), proper_scores(rows), expected_calibration_error(rows), decision_rates(rows, threshold)):
        out = out.crossJoin(part)
    return out


def usable_operating_points(rows: DataFrame, specificities: Sequence[float] = (0.95, 0.97, 0.99), coverages: Sequence[float] = (0.5, 0.7, 0.9, 1.0)) -> DataFrame:
    """(metric, at, value): what a usability score is worth, as rows: area, precision, sensitivity at specificities,
    and false usables among the best-scored share."""
    flat = lambda df, name, at, value: df.select(F.lit(name).alias("metric"), at.cast("double").alias("at"), value.cast("double").alias("value"))
    none = F.lit(None)
    precision, spots, risk = average_precision(rows), sensitivity_at_specificity(rows, specificities), coverage_risk(rows, coverages)
    out = flat(auroc(rows), "auroc", none, F.col("auroc"))
    for part in (
        flat(precision, "average_precision", none, F.col("ap")), flat(precision, "chance", none, F.col("chance")),
        flat(spots, "sensitivity", F.col("target"), F.col("sensitivity")), flat(risk, "retained_false_usable", F.col("target"), F.col("retained_false_usable")),
    ):
        out = out.unionByName(part)
    return out


def one_versus_rest(rows: DataFrame, labels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """(label, auroc, status) of rows (y, probs): the area of each class's probability against all others; a class that is
    absent, or alone, has no area and says so."""
    out = None
    for k, label in enumerate(labels):
        one = rows.select((F.col("y") == label).cast("long").alias("y"), F.col("probs")[k].alias("score"))
        n = one.agg(F.sum("y").alias("p"), F.count("*").alias("n"))
        status = F.when(F.col("p") == 0, "absent").when(F.col("p") == F.col("n"), "alone").otherwise("ok")
        row = auroc(one).crossJoin(n).select(F.lit(label).alias("label"), "auroc", status.alias("status"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
