"""Queries over labels: metrics of graders and statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluation import metrics, statistics
from ..functions import labels as L
from ..operators import labelled
from .sql import BINARY, GRADED, GRADES, SAMPLES
from .views import binary, graded_docs, grades, rounded, samples

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CM = GRADED + """,
grid AS (SELECT a.k AS y, b.k AS p FROM (SELECT unnest([0, 1, 2, 3]) AS k) a, (SELECT unnest([0, 1, 2, 3]) AS k) b),
cm AS (SELECT grid.y, grid.p, count(g.doc_id) AS n FROM grid LEFT JOIN g ON g.y = grid.y AND g.p = grid.p GROUP BY 1, 2)"""

CLASSES = CM + """,
pc AS (SELECT k AS label, (SELECT sum(n) FROM cm WHERE y = k AND p = k) AS tp, (SELECT sum(n) FROM cm WHERE y = k) AS support, (SELECT sum(n) FROM cm WHERE p = k) AS called, (SELECT sum(n) FROM cm) AS total FROM (SELECT unnest([0, 1, 2, 3]) AS k)),
ps AS (SELECT label, support, total, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, (total - support - called + tp) / (total - support) AS specificity FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ps)"""


@query("confusion", f"WITH {CM} SELECT y::INT AS y, p::INT AS p, n FROM cm")
def confusion(spark, sf):
    return metrics.confusion(graded_docs(spark, sf))


@query("per_class", f"WITH {CLASSES} SELECT label::INT AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf")
def per_class(spark, sf):
    return rounded(metrics.per_class(metrics.confusion(graded_docs(spark, sf))))


@query("evaluate", f"WITH {CLASSES}, w AS (SELECT y, p, n, abs(y - p) AS d, (sum(n) OVER (PARTITION BY y)) * (sum(n) OVER (PARTITION BY p)) / (sum(n) OVER ()) AS e, sum(n) OVER () AS t FROM cm), o AS (SELECT sum(CASE WHEN d = 0 THEN n ELSE 0 END) / max(t) AS accuracy, 1 - sum(CASE WHEN d > 0 THEN n ELSE 0 END) / sum(CASE WHEN d > 0 THEN e ELSE 0 END) AS kappa, 1 - sum(d * n) / sum(d * e) AS linear_kappa, 1 - sum(d * d * n) / sum(d * d * e) AS qwk FROM w), c AS (SELECT avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM pf) SELECT round(accuracy, 6) AS accuracy, round(kappa, 6) AS kappa, round(linear_kappa, 6) AS linear_kappa, round(qwk, 6) AS qwk, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM o, c")
def evaluate(spark, sf):
    return rounded(metrics.evaluate(graded_docs(spark, sf)))


STEPS = BINARY + """,
st AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM b GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM st WINDOW w AS (ORDER BY score DESC))"""


@query("auroc", f"WITH {STEPS} SELECT round(sum(pos * (nn - fp + neg / 2.0)) / (max(pp) * max(nn)), 6) AS auroc FROM cu")
def auroc(spark, sf):
    return rounded(metrics.auroc(binary(spark, sf)))


@query("average_precision", f"WITH {STEPS} SELECT round(sum(pos * tp / (tp + fp)) / max(pp), 6) AS ap, round(max(pp) / (max(pp) + max(nn)), 6) AS chance FROM cu")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(binary(spark, sf)))


@query("sensitivity_at_specificity", f"WITH {STEPS}, pt AS (SELECT score, tp / pp AS tpr, fp / nn AS fpr FROM cu UNION ALL SELECT 'inf'::DOUBLE, 0, 0), r AS (SELECT t.target, pt.*, row_number() OVER (PARTITION BY t.target ORDER BY tpr DESC, fpr) AS k FROM pt, (SELECT unnest([0.95, 0.97, 0.99])::DOUBLE AS target) t WHERE 1 - fpr >= t.target) SELECT target, round(tpr, 6) AS sensitivity, round(1 - fpr, 6) AS specificity, CASE WHEN isinf(score) THEN 9.0 ELSE round(score, 6) END AS threshold FROM r WHERE k = 1")
def sensitivity_at_specificity(spark, sf):
    rows = metrics.sensitivity_at_specificity(binary(spark, sf))
    return rounded(rows.withColumn("threshold", F.when(F.col("threshold") == float("inf"), 9.0).otherwise(F.col("threshold"))))


@query("proper_scores", f"WITH {BINARY}, c AS (SELECT y, score, least(greatest(score, 1e-12), 1 - 1e-12) AS p FROM b) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll, round(avg((score - y) * (score - y)), 6) AS brier FROM c")
def proper_scores(spark, sf):
    return rounded(metrics.proper_scores(binary(spark, sf)))


REL = BINARY + ", rl AS (SELECT CAST(greatest(0, least(14, ceil(score * 15) - 1)) AS INT) AS bin, count(*) AS count, avg(score) AS mean_score, avg(y) AS mean_true FROM b GROUP BY 1)"


@query("reliability", f"WITH {REL} SELECT bin, count, round(mean_score, 6) AS mean_score, round(mean_true, 6) AS mean_true FROM rl")
def reliability(spark, sf):
    return rounded(metrics.reliability(binary(spark, sf)))


@query("calibration_error", f"WITH {REL} SELECT round(sum(count * abs(mean_score - mean_true)) / sum(count), 6) AS ece FROM rl")
def calibration_error(spark, sf):
    return rounded(metrics.expected_calibration_error(binary(spark, sf)))


@query("decision_rates", f"WITH {BINARY}, r AS (SELECT avg(CASE WHEN y = 0 THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS w, avg(CASE WHEN y = 1 THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS u FROM b) SELECT round(w, 6) AS false_usable, round(1 - u, 6) AS false_unusable, round(u, 6) AS usable_recall, round(1 - w, 6) AS unusable_recall, round((u + 1 - w) / 2, 6) AS balanced FROM r")
def decision_rates(spark, sf):
    return rounded(metrics.decision_rates(binary(spark, sf)))


@query("coverage_risk", f"WITH {STEPS}, k AS (SELECT t.target, tp + fp AS kept, fp, pp + nn AS n, row_number() OVER (PARTITION BY t.target ORDER BY tp + fp) AS r FROM cu, (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS target) t WHERE tp + fp >= ceil(t.target * (pp + nn))) SELECT target, round(kept / n, 6) AS coverage, round(fp / kept, 6) AS retained_false_usable FROM k WHERE r = 1")
def coverage_risk(spark, sf):
    return rounded(metrics.coverage_risk(binary(spark, sf)))


REPORT = STEPS + REL[len(BINARY) :] + """,
r1 AS (SELECT sum(pos * (nn - fp + neg / 2.0)) / (max(pp) * max(nn)) AS auroc, sum(pos * tp / (tp + fp)) / max(pp) AS ap, max(pp) / (max(pp) + max(nn)) AS chance FROM cu),
r2 AS (SELECT avg(-(y * ln(least(greatest(score, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(score, 1e-12), 1 - 1e-12)))) AS nll, avg((score - y) * (score - y)) AS brier, avg(CASE WHEN y = 0 THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS w, avg(CASE WHEN y = 1 THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS u FROM b),
r3 AS (SELECT sum(count * abs(mean_score - mean_true)) / sum(count) AS ece FROM rl)"""


@query("binary_report", f"WITH {REPORT} SELECT round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(chance, 6) AS chance, round(nll, 6) AS nll, round(brier, 6) AS brier, round(ece, 6) AS ece, round(w, 6) AS false_usable, round(1 - u, 6) AS false_unusable, round(u, 6) AS usable_recall, round(1 - w, 6) AS unusable_recall, round((u + 1 - w) / 2, 6) AS balanced FROM r1, r2, r3")
def binary_report(spark, sf):
    return rounded(metrics.binary_report(binary(spark, sf)))


POINTS = STEPS + """,
pt AS (SELECT tp / pp AS tpr, fp / nn AS fpr FROM cu UNION ALL SELECT 0, 0),
op AS (SELECT t.target, max(tpr) AS sens FROM pt, (SELECT unnest([0.95, 0.97, 0.99])::DOUBLE AS target) t WHERE 1 - fpr >= t.target GROUP BY 1),
rk AS (SELECT t.target, fp / (tp + fp) AS risk, row_number() OVER (PARTITION BY t.target ORDER BY tp + fp) AS r FROM cu, (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS target) t WHERE tp + fp >= ceil(t.target * (pp + nn))),
on1 AS (SELECT sum(pos * (nn - fp + neg / 2.0)) / (max(pp) * max(nn)) AS auroc, sum(pos * tp / (tp + fp)) / max(pp) AS ap, max(pp) / (max(pp) + max(nn)) AS chance FROM cu)"""


@query("usable_operating_points", f"WITH {POINTS} SELECT 'auroc' AS metric, NULL::DOUBLE AS at, round(auroc, 6) AS value FROM on1 UNION ALL SELECT 'average_precision', NULL, round(ap, 6) FROM on1 UNION ALL SELECT 'chance', NULL, round(chance, 6) FROM on1 UNION ALL SELECT 'sensitivity', target, round(sens, 6) FROM op UNION ALL SELECT 'retained_false_usable', target, round(risk, 6) FROM rk WHERE r = 1")
def usable_operating_points(spark, sf):
    return rounded(metrics.usable_operating_points(binary(spark, sf)))


@query("one_versus_rest", f"WITH {GRADED}, pr AS (SELECT y, k, 1.0 / (1 + abs(p - k)) AS s FROM g, (SELECT unnest([0, 1, 2, 3]) AS k)), st AS (SELECT k, s, sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = k THEN 0 ELSE 1 END) AS neg FROM pr GROUP BY 1, 2), cu AS (SELECT *, sum(neg) OVER (PARTITION BY k ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY k) AS pp, sum(neg) OVER (PARTITION BY k) AS nn FROM st) SELECT CAST(k AS INT) AS label, CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN round(sum(pos * (nn - fp + neg / 2.0)) / (max(pp) * max(nn)), 6) END AS auroc, CASE WHEN max(pp) = 0 THEN 'absent' WHEN max(nn) = 0 THEN 'alone' ELSE 'ok' END AS status FROM cu GROUP BY 1")
def one_versus_rest(spark, sf):
    probs = F.array(*(F.lit(1.0) / (1 + F.abs(F.col("p") - k)) for k in range(4)))
    return rounded(metrics.one_versus_rest(graded_docs(spark, sf).withColumn("probs", probs)))


@query("overlap_accuracy", f"WITH {GRADED} SELECT round(avg(CASE WHEN abs(y - p) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS overlap_accuracy FROM g")
def overlap_accuracy(spark, sf):
    return rounded(metrics.overlap_accuracy(graded_docs(spark, sf)))


@query("run_summary", f"WITH {BINARY} SELECT lang, round(avg(score), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(score) ELSE 0 END, 6) AS std, count(*) AS n FROM b GROUP BY 1")
def run_summary(spark, sf):
    return rounded(metrics.summarize(binary(spark, sf), "lang", "score"))


@query("leave_one_out", f"WITH {BINARY}, s AS (SELECT cluster AS held_out, count(*) AS test, sum(count(*)) OVER () AS total FROM b GROUP BY 1) SELECT held_out, 'test' AS role, test AS n FROM s UNION ALL SELECT held_out, 'train', CAST(total - test AS BIGINT) FROM s")
def leave_one_out(spark, sf):
    return statistics.leave_one_out(binary(spark, sf), "cluster")


@query("nested_fractions", f"WITH {BINARY}, r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM b) SELECT f AS fraction, doc_id, y FROM r, (SELECT unnest([0.1, 0.5])::DOUBLE AS f) WHERE r <= greatest(1, floor(f * n + 0.5))")
def nested_fractions(spark, sf):
    return statistics.nested_fractions(binary(spark, sf), "doc_id", "y", (0.1, 0.5))


RANKED = BINARY + """, d AS (SELECT round(score - y * 0.7, 3) AS d FROM b), k AS (SELECT abs(d) AS m, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up, count(*) AS k FROM d WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0 AS rk FROM k), s AS (SELECT sum(k) AS n, sum(rk * up) AS plus, sum(rk * k) AS tot, sum(pow(k, 3) - k) AS ties FROM r)"""


@query("wilcoxon", f"WITH {RANKED} SELECT round(least(plus, tot - plus), 6) AS statistic, CAST(n AS BIGINT) AS n, round((plus - tot / 2) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) AS z, (SELECT round(quantile_cont(d, 0.5), 6) FROM d) AS median_diff FROM s")
def wilcoxon(spark, sf):
    rows = binary(spark, sf).select(F.round(F.col("score") - F.col("y") * 0.7, 3).alias("a"), F.lit(0.0).alias("b"))
    return rounded(statistics.wilcoxon(rows, "a", "b"))


@query("wilcoxon_p_value", f"WITH {RANKED}, z AS (SELECT abs((plus - tot / 2) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)) / sqrt(2) AS x FROM s), t AS (SELECT x, 1 / (1 + 0.3275911 * x) AS t FROM z) SELECT round(least(1.0, ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)), 6) AS p_value FROM t")
def wilcoxon_p_value(spark, sf):
    rows = binary(spark, sf).select(F.round(F.col("score") - F.col("y") * 0.7, 3).alias("a"), F.lit(0.0).alias("b"))
    return rounded(statistics.wilcoxon(rows, "a", "b").select(statistics.two_sided(F.col("z")).alias("p_value")))


@query("folds", f"WITH {BINARY}, c AS (SELECT DISTINCT cluster AS held_out FROM b) SELECT doc_id, held_out, CASE WHEN cluster IS NOT DISTINCT FROM held_out THEN 'test' ELSE 'train' END AS role FROM b, c")
def folds(spark, sf):
    return statistics.folds(binary(spark, sf), "cluster").select("doc_id", "held_out", "role")


PVALUES = BINARY + ", pv AS (SELECT cluster AS test, round(pow(avg(y), 20), 9) AS p_value FROM b GROUP BY 1)"


@query("benjamini_hochberg", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS r, count(*) OVER () AS m FROM pv), q AS (SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC)) AS q_value FROM r) SELECT test, p_value, round(q_value, 6) AS q_value, q_value <= 0.05 AS rejected FROM q")
def benjamini_hochberg(spark, sf):
    tests = binary(spark, sf).groupBy(F.col("cluster").alias("test")).agg(F.round(F.pow(F.avg("y"), F.lit(20.0)), 9).alias("p_value"))
    out = statistics.benjamini_hochberg(tests)
    return out.withColumn("q_value", F.round("q_value", 6))


@query("nested_selection", f"WITH {BINARY}, s AS (SELECT CAST(floor(score * 3) AS INT)::VARCHAR AS arm, lang AS cohort, avg(y) AS value FROM b GROUP BY 1, 2), o AS (SELECT *, (sum(value) OVER a - value) / (count(*) OVER a - 1) AS others FROM s WINDOW a AS (PARTITION BY arm)), k AS (SELECT value, row_number() OVER (PARTITION BY cohort ORDER BY round(others, 12) DESC, arm) AS r FROM o), f AS (SELECT max(m) AS flat FROM (SELECT avg(value) AS m FROM s GROUP BY arm)), n AS (SELECT avg(value) AS nested FROM k WHERE r = 1) SELECT round(flat, 6) AS flat_mean, round(nested, 6) AS nested_mean, round(flat - nested, 6) AS optimism FROM f, n")
def nested_selection(spark, sf):
    rows = binary(spark, sf).groupBy(F.floor(F.col("score") * 3).cast("int").cast("string").alias("arm"), F.col("lang").alias("cohort")).agg(F.avg("y").alias("value"))
    return rounded(statistics.nested_selection(rows))


@query("cluster_error", f"WITH {BINARY}, s AS (SELECT cluster, sum(score) AS s, count(*) AS k FROM b GROUP BY 1), m AS (SELECT *, sum(s) OVER () / sum(k) OVER () AS m FROM s) SELECT round(max(m), 6) AS mean, round(sqrt(count(*) / (count(*) - 1.0) * sum(pow(s - k * m, 2))) / sum(k), 6) AS se, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_clusters FROM m")
def cluster_error(spark, sf):
    return rounded(statistics.cluster_error(binary(spark, sf), "score", "cluster"))


for _method in ("t", "percentile", "bca"):

    @query(f"cluster_interval_{_method}")
    def _interval(spark, sf, method=_method):
        return rounded(statistics.cluster_interval(binary(spark, sf), "score", "cluster", method))


SPANS = SAMPLES + """,
spans AS (SELECT rec, k AS ord, k * 12 AS s, k * 12 + 15 AS e, 'Q' || ((rec + k) % 4) AS label, CASE WHEN k % 2 = 0 THEN 'motion_muscle' ELSE 'baseline' END AS kind FROM lens, range(0, 4) r(k)),
lab AS (SELECT rec, n, x, label, kind FROM (SELECT a.rec, a.n, a.x, s.label, s.kind, row_number() OVER (PARTITION BY a.rec, a.n ORDER BY s.ord DESC) AS r FROM samples a JOIN spans s ON s.rec = a.rec AND a.n >= s.s AND a.n < s.e) WHERE r = 1)"""


def spans(spark, sf):
    rows = samples(spark, sf).groupBy("rec").agg(F.count("*").alias("len")).withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(3))))
    label = F.concat(F.lit("Q"), ((F.col("rec") + F.col("ord")) % 4).cast("string"))
    kind = F.when(F.col("ord") % 2 == 0, "motion_muscle").otherwise("baseline")
    return rows.select("rec", "ord", (F.col("ord") * 12).alias("s"), (F.col("ord") * 12 + 15).alias("e"), label.alias("label"), kind.alias("kind"))


@query("sample_labels", f"WITH {SPANS} SELECT rec, n, label FROM lab")
def sample_labels(spark, sf):
    return labelled.sample_labels(samples(spark, sf), spans(spark, sf)).select("rec", "n", "label")


WINDOWED = SPANS + """,
gw AS (SELECT rec, unnest(range(0, len - 20 + 1, 20)) AS w FROM lens WHERE len >= 20),
ws AS (SELECT g.rec, g.w, a.label, count(*) AS n FROM gw g JOIN samples s ON s.rec = g.rec AND s.n >= g.w AND s.n < g.w + 20 LEFT JOIN lab a ON a.rec = s.rec AND a.n = s.n GROUP BY 1, 2, 3)"""


@query("labelled_windows", f"WITH {WINDOWED} SELECT rec, w AS start_n, min(label) AS worst, arg_min(label, -n * 10 + CAST(substr(label, 2, 1) AS INT)) AS major, round(sum(CASE WHEN label IN ('Q0', 'Q1') THEN n ELSE 0 END) / sum(n), 6) AS burden FROM ws WHERE label IS NOT NULL GROUP BY 1, 2 HAVING sum(n) >= 10")
def labelled_windows(spark, sf):
    return rounded(labelled.windowize(samples(spark, sf), spans(spark, sf), 20, 20, 0.5))


def _share_grade(x: str) -> str:
    return f"CASE WHEN round({x}, 9) <= 0.05 THEN 3 WHEN round({x}, 9) <= 0.35 THEN 2 WHEN round({x}, 9) <= 0.5 THEN 1 ELSE 0 END"


@query("window_grades", f"WITH {WINDOWED}, q AS (SELECT g.rec, g.w, count(a.label) AS n, avg(CASE WHEN a.label = 'Q3' THEN 0.0 WHEN a.label IS NOT NULL THEN 1.0 END) AS bad, avg((3 - CAST(substr(a.label, 2, 1) AS INT)) / 3.0) AS burden, min(CAST(substr(a.label, 2, 1) AS INT)) AS worst, max(s.x) = min(s.x) AS flat FROM gw g JOIN samples s ON s.rec = g.rec AND s.n >= g.w AND s.n < g.w + 20 LEFT JOIN lab a ON a.rec = s.rec AND a.n = s.n GROUP BY 1, 2) SELECT rec, w AS start_n, CASE WHEN flat THEN 0 ELSE {_share_grade('bad')} END AS by_fraction, CASE WHEN flat THEN 0 ELSE greatest({_share_grade('burden')}, worst) END AS by_burden, flat FROM q WHERE n >= 10")
def window_grades(spark, sf):
    return labelled.window_grades(samples(spark, sf), spans(spark, sf), 20, 20, 0.5)


@query("canonical_types", f"WITH {SPANS} SELECT DISTINCT kind, CASE kind WHEN 'motion_muscle' THEN 'motion|muscle' ELSE 'wander' END AS types FROM spans")
def canonical_types(spark, sf):
    return spans(spark, sf).select("kind").distinct().select("kind", F.array_join(L.canonical_types(F.col("kind")), "|").alias("types"))


@query("multi_hot", f"WITH {SPANS} SELECT DISTINCT kind, CASE kind WHEN 'motion_muscle' THEN '1,1,0' ELSE '0,0,1' END AS hot FROM spans")
def multi_hot(spark, sf):
    hot = L.multi_hot(L.canonical_types(F.col("kind")), ["motion", "muscle", "wander"])
    return spans(spark, sf).select("kind").distinct().select("kind", F.array_join(F.transform(hot, lambda v: v.cast("string")), ",").alias("hot"))


@query("dense_track", f"WITH {GRADES}, d AS (SELECT s.rec, s.n, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c, avg(p3) AS d FROM samples s JOIN grades g ON g.rec = s.rec AND s.n >= g.start_n AND s.n < g.start_n + 32 GROUP BY 1, 2) SELECT rec, n, CASE greatest(round(a, 9), round(b, 9), round(c, 9), round(d, 9)) WHEN round(a, 9) THEN 0 WHEN round(b, 9) THEN 1 WHEN round(c, 9) THEN 2 ELSE 3 END AS grade FROM d")
def dense_track(spark, sf):
    return labelled.dense_track(grades(spark, sf), 32)


@query("dense_intervals", f"WITH {GRADES}, d AS (SELECT s.rec, s.n, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c, avg(p3) AS d FROM samples s JOIN grades g ON g.rec = s.rec AND s.n >= g.start_n AND s.n < g.start_n + 32 GROUP BY 1, 2), t AS (SELECT rec, n, CASE greatest(round(a, 9), round(b, 9), round(c, 9), round(d, 9)) WHEN round(a, 9) THEN 0 WHEN round(b, 9) THEN 1 WHEN round(c, 9) THEN 2 ELSE 3 END AS grade FROM d), r AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY n) AS run FROM (SELECT *, CASE WHEN lag(grade) OVER (PARTITION BY rec ORDER BY n) = grade THEN 0 ELSE 1 END AS nw FROM t)) SELECT rec, min(n) AS start_n, max(n) + 1 AS end_n, min(grade) AS grade FROM r GROUP BY rec, run HAVING count(*) >= 5")
def dense_intervals(spark, sf):
    return labelled.dense_intervals(labelled.dense_track(grades(spark, sf), 32), 5)


@query("dense_evaluation", f"WITH {GRADES}, {SPANS[len(SAMPLES) + 1 :]}, d AS (SELECT s.rec, s.n, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c, avg(p3) AS d FROM samples s JOIN grades g ON g.rec = s.rec AND s.n >= g.start_n AND s.n < g.start_n + 32 GROUP BY 1, 2), t AS (SELECT rec, n, CASE greatest(round(a, 9), round(b, 9), round(c, 9), round(d, 9)) WHEN round(a, 9) THEN 0 WHEN round(b, 9) THEN 1 WHEN round(c, 9) THEN 2 ELSE 3 END AS grade FROM d), e AS (SELECT CAST(substr(label, 2, 1) AS INT) AS y, grade AS p FROM t JOIN lab ON lab.rec = t.rec AND lab.n = t.n) SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e")
def dense_evaluation(spark, sf):
    track = labelled.dense_track(grades(spark, sf), 32)
    truth = labelled.sample_labels(samples(spark, sf), spans(spark, sf)).select("rec", "n", "label")
    return rounded(labelled.dense_evaluation(track, truth).select("accuracy"))
