"""Resampling statistics: splits, paired tests, multiplicity, cluster errors and intervals."""
from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranges import running_sums
from ..runtime import written


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """(held_out, role, n): for every value of `group`, how many rows train and test. Sizes only: the rows of a fold are
    `group <> held_out` and `group = held_out`, which need no copy of the table."""
    sizes = rows.groupBy(F.col(group).alias("held_out")).agg(F.count("*").alias("test"))
    every = sizes.withColumn("all", F.sum("test").over(W.partitionBy()))
    pair = F.array(F.struct(F.lit("test").alias("role"), F.col("test").alias("n")), F.struct(F.lit("train").alias("role"), (F.col("all") - F.col("test")).alias("n")))
    return every.select("held_out", F.explode(pair).alias("p")).select("held_out", "p.*")


def folds(rows: DataFrame, group: str) -> DataFrame:
    """`rows` with held_out and role: every row once in each fold, as test where its group is held out, else as train.
    Groups are few: their names are a broadcast of at most `MOST_FOLDS`, more are refused."""
    names = [r[0] for r in rows.select(group).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(names) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups: hold out folds of groups instead")
    kind = rows.schema[group].dataType.simpleString()
    held = rows.withColumn("held_out", F.explode(F.array(*(F.lit(n).cast(kind) for n in sorted(names, key=lambda n: (n is None, str(n)))))))
    return held.withColumn("role", F.when(F.col(group).eqNullSafe(F.col("held_out")), "test").otherwise("train"))


#: Groups that may each be held out in turn; every row is repeated as often.
MOST_FOLDS = 256


def nested_fractions(rows: DataFrame, key: str, label: str, fractions: Sequence[float], least: int = 1) -> DataFrame:
    """(fraction, key, label): nested subsets of each class, in order of a hash of the key, at least `least` a class."""
    w = W.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    ranked = rows.select(key, label, F.row_number().over(w).alias("r"), F.count("*").over(W.partitionBy(label)).alias("n"))
    each = ranked.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    take = F.greatest(F.lit(least), F.floor(F.col("fraction") * F.col("n") + 0.5))
    return each.filter(F.col("r") <= take).select("fraction", key, label)


#: The rational approximation 7.1.26 of the error function by Abramowitz and Stegun, within 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(z: Column) -> Column:
    """The two-sided p-value of a standard normal z."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + ERF_P * x)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return F.least(F.lit(1.0), series * F.exp(-x * x))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, n, median_diff, z): signed ranks of a - b with mean ranks for ties, zeros left out; z by the normal
    approximation without continuity correction."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d"))
    by = d.filter("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.count("*").alias("k"))
    by = running_sums(written(by, "differences"), "m", {"before": "k"}, [])
    by = by.withColumn("rank", F.col("before") + (F.col("k") + 1) / 2.0)
    n, plus, both = F.sum("k"), F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * F.col("k"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.sum(F.pow(F.col("k"), F.lit(3.0)) - F.col("k")) / 48.0)
    one = by.agg(F.least(plus, both - plus).alias("statistic"), n.alias("n"), ((plus - both / 2) / spread).alias("z"))
    return one.crossJoin(d.agg(F.percentile("d", F.lit(0.5)).alias("median_diff")))  # one row each


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """`tests` with q_value and rejected: the running least of m p / rank from the greatest p downwards, at most 1. Tests
    are hypotheses, few enough for one task."""
    up = W.orderBy(p)
    ranked = tests.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count("*").over(W.partitionBy()))
    down = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))
    return ranked.withColumn("q_value", q).withColumn("rejected", F.col("q_value") <= alpha).drop("_r", "_m")


def nested_selection(scores: DataFrame) -> DataFrame:
    """(flat_mean, nested_mean, optimism) of picking an arm by its mean over cohorts, from (arm, cohort, value). The arm
    for a cohort is chosen on the others; ties go to the first name."""
    of = W.partitionBy("arm")
    rows = scores.withColumn("s", F.sum("value").over(of)).withColumn("g", F.count("*").over(of))
    rows = rows.withColumn("others", (F.col("s") - F.col("value")) / (F.col("g") - 1))
    pick = rows.withColumn("r", F.row_number().over(W.partitionBy("cohort").orderBy(F.desc(F.round("others", 12)), "arm"))).filter("r = 1")
    nested = pick.agg(F.avg("value").alias("nested_mean"))
    flat = scores.groupBy("arm").agg(F.avg("value").alias("m")).agg(F.max("m").alias("flat_mean"))
    return flat.crossJoin(nested).withColumn("optimism", F.col("flat_mean") - F.col("nested_mean"))  # one row each


def cluster_error(rows: DataFrame, value: str, cluster: str) -> DataFrame:
    """(mean, se, n, n_clusters): the cluster-robust standard error of a mean; null for fewer than two clusters."""
    sums = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    every = W.partitionBy()
    sums = sums.withColumn("m", F.sum("s").over(every) / F.sum("k").over(every))
    g, n = F.count("*"), F.sum("k")
    se = F.when(g >= 2, F.sqrt(g / (g - 1) * F.sum(F.pow(F.col("s") - F.col("k") * F.col("m"), F.lit(2.0)))) / n)
    return sums.agg(F.max("m").alias("mean"), se.alias("se"), n.alias("n"), g.alias("n_clusters"))


def t_quantile(p: float, df: int) -> float:
    """Student's t by its series in the normal quantile, with closed forms for one and two degrees of freedom."""
    import math

    if df == 1:
        return math.tan(math.pi * (p - 0.5))
    if df == 2:
        a = 2 * p - 1
        return a * math.sqrt(2 / (1 - a * a))
    z = NormalDist().inv_cdf(p)
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return sum(t / df**k for k, t in enumerate(terms))


def cluster_interval(rows: DataFrame, value: str, cluster: str, method: str = "t", alpha: float = 0.05, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(mean, lo, hi, n_clusters): an interval for the mean by Student's t on the clusters, or from resampled clusters
    (percentile, bca). Draws are hashes of (seed, replicate, draw), so a rerun gives the same interval. What is resampled
    are cluster sums: replicates times clusters rows, whatever the number of values."""
    if method == "t":
        one = cluster_error(rows, value, cluster)
        g = one.first()["n_clusters"]
        crit = t_quantile(1 - alpha / 2, g - 1) if g > 1 else 0.0
        return one.select("mean", (F.col("mean") - crit * F.coalesce("se", F.lit(0.0))).alias("lo"), (F.col("mean") + crit * F.coalesce("se", F.lit(0.0))).alias("hi"), "n_clusters")
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method}")
    boot, sums = replicates(rows, value, cluster, n_boot, seed)
    low, high = alpha / 2, 1 - alpha / 2
    mean = sums.agg((F.sum("s") / F.sum("k")).alias("m"), F.count("*").alias("g")).first()
    if method == "bca":
        share = boot.agg(F.avg((F.col("m") < mean["m"]).cast("double"))).first()[0]
        nd = NormalDist()
        z0 = nd.inv_cdf(min(max(share, 1 / (2 * n_boot)), 1 - 1 / (2 * n_boot)))
        every = W.partitionBy()
        jack = sums.select(((F.sum("s").over(every) - F.col("s")) / (F.sum("k").over(every) - F.col("k"))).alias("j"))
        jack = jack.select((F.avg("j").over(every) - F.col("j")).alias("d")).agg(F.sum(F.pow("d", F.lit(3.0))).alias("c"), F.sum(F.pow("d", F.lit(2.0))).alias("v")).first()
        a = jack["c"] / (6 * jack["v"] ** 1.5) if jack["v"] else 0.0
        adjust = lambda p: min(1 - 1e-6, max(1e-6, nd.cdf(z0 + (z0 + nd.inv_cdf(p)) / (1 - a * (z0 + nd.inv_cdf(p))))))
        low, high = adjust(low), adjust(high)
    cut = boot.agg(F.percentile("m", F.lit(low)).alias("lo"), F.percentile("m", F.lit(high)).alias("hi"))
    return cut.select(F.lit(mean["m"]).alias("mean"), "lo", "hi", F.lit(mean["g"]).alias("n_clusters"))


def replicates(rows: DataFrame, value: str, cluster: str, n_boot: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(replicate, m) of means over drawn clusters, and the cluster sums they are drawn from."""
    sums = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(cluster).alias("c")).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    sums = written(sums.withColumn("_h", F.xxhash64("c")).withColumn("_one", F.lit(1)), "cluster-sums")
    g = sums.count()
    sums = running_sums(sums, "_h", {"i": "_one"}, ["c"]).select("c", "s", "k", F.col("i").cast("int").alias("i"))
    draws = rows.sparkSession.range(n_boot).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(g, 1) - 1))).alias("draw"))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "replicate", "draw"), F.lit(max(g, 1))).cast("int"))
    return draws.join(sums, "i").groupBy("replicate").agg((F.sum("s") / F.sum("k")).alias("m")), sums
