"""Queries over windows, grades and intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import pyramid, quality, refine, review, segments, windows
from ..sources import tables
from .sql import FLAWED, GRADES, INTERVALS, LENGTH, RUNS, SAMPLES, STARTS, STATS, STEP, TAGGED, flat_rows
from .views import grades, intervals, rounded, samples, tagged

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = "round({0}, 6) AS {0}".format


@query("recording_samples", f"WITH {SAMPLES} SELECT rec, n, x FROM samples")
def recording_samples(spark, sf):
    return samples(spark, sf)


@query("read_window", "SELECT channel, n, round(x, 6) AS x FROM (SELECT 'l_quantity' AS channel, l_orderkey AS n, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_tax', l_orderkey, l_tax FROM lineitem) WHERE n >= 100 AND n < 200")
def read_window(spark, sf):
    rows = tables.table(spark, sf, "lineitem")
    channels = [c for c in tables.channels_of(rows) if c in ("l_quantity", "l_tax")]
    return rounded(tables.read_window(tables.to_long(rows, "l_orderkey", channels), channels, 100, 200))


@query("window_starts", f"WITH {STARTS} SELECT rec, start_n FROM starts")
def window_starts(spark, sf):
    return windows.window_starts(samples(spark, sf), LENGTH, STEP)


@query("not_analysed", f"WITH {SAMPLES} SELECT rec, len, 64 AS needed FROM lens WHERE len < 64")
def not_analysed(spark, sf):
    return windows.not_analysed(samples(spark, sf), 64)


@query("ungraded_tail", f"WITH {SAMPLES} SELECT rec, CAST(len - ((len - {LENGTH}) // {STEP} * {STEP} + {LENGTH}) AS BIGINT) AS tail FROM lens WHERE len >= {LENGTH}")
def ungraded_tail(spark, sf):
    return windows.ungraded_tail(samples(spark, sf), LENGTH, STEP)


@query("window_stats", f"WITH {STATS} SELECT rec, start_n, {R('m')}, {R('sd')}, {R('lo')}, {R('hi')} FROM stats")
def window_stats(spark, sf):
    return rounded(windows.window_stats(samples(spark, sf), LENGTH, STEP))


@query("normalized_windows", f"WITH {STARTS}, s AS (SELECT t.rec, t.start_n, s.n - t.start_n AS pos, x FROM starts t JOIN samples s ON s.rec = t.rec AND s.n >= t.start_n AND s.n < t.start_n + {LENGTH}) SELECT rec, start_n, CAST(pos AS INT) AS pos, round(CASE WHEN max(x) OVER w - min(x) OVER w > 1e-8 THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END, 6) AS x FROM s WINDOW w AS (PARTITION BY rec, start_n)")
def normalized_windows(spark, sf):
    rows = windows.windowed(samples(spark, sf), LENGTH, STEP)
    held = rows.groupBy("rec", "start_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("w"))
    return rounded(windows.normalized(held, "minmax").select("rec", "start_n", F.posexplode("w").alias("pos", "x")))


@query("graded_windows", f"WITH {GRADES} SELECT rec, start_n, tier, {R('confidence')}, {R('uncertainty')}, {R('p0')}, {R('p1')}, {R('p2')}, {R('p3')} FROM grades")
def graded_windows(spark, sf):
    rows = grades(spark, sf)
    return rounded(rows.select("rec", "start_n", "tier", "confidence", "uncertainty", *(F.col("probs")[k].alias(f"p{k}") for k in range(4))))


@query("stub_grades", f"WITH {STATS} SELECT rec, start_n, CASE WHEN hi > 1.0 THEN 'Q0' ELSE 'Q3' END AS tier, CASE WHEN hi > 1.0 THEN 0.42 ELSE 0.91 END::DOUBLE AS confidence FROM stats")
def stub_grades(spark, sf):
    return windows.stub_grades(windows.window_stats(samples(spark, sf), LENGTH, STEP)).select("rec", "start_n", "tier", "confidence")


@query("run_length_intervals", f"WITH {INTERVALS} SELECT rec, run, tier, {R('confidence')}, {R('uncertainty')}, n_windows, {R('start_sec')}, {R('end_sec')} FROM intervals")
def run_length_intervals(spark, sf):
    return rounded(intervals(spark, sf).select("rec", "run", "tier", "confidence", "uncertainty", "n_windows", "start_sec", "end_sec"))


@query("window_intervals", f"WITH {GRADES} SELECT rec, start_n::DOUBLE AS start_sec, (start_n + {LENGTH})::DOUBLE AS end_sec, tier FROM grades")
def window_intervals(spark, sf):
    return segments.window_intervals(grades(spark, sf), LENGTH).select("rec", "start_sec", "end_sec", "tier")


@query("usable_share", f"WITH {INTERVALS} SELECT rec, round(sum(CASE WHEN tier IN ('Q2', 'Q3') THEN end_sec - start_sec ELSE 0 END) / sum(end_sec - start_sec), 6) AS usable, round(sum(CASE WHEN tier = 'Q0' THEN end_sec - start_sec ELSE 0 END) / sum(end_sec - start_sec), 6) AS flagged FROM intervals GROUP BY rec")
def usable_share(spark, sf):
    return rounded(segments.shares(intervals(spark, sf)))


@query("tier_fractions", f"WITH {INTERVALS} SELECT rec, tier, round(sum(end_sec - start_sec) / sum(sum(end_sec - start_sec)) OVER (PARTITION BY rec), 6) AS fraction FROM intervals GROUP BY rec, tier")
def tier_fractions(spark, sf):
    return rounded(segments.tier_fractions(intervals(spark, sf)))


@query("poor_intervals", f"WITH {INTERVALS} SELECT rec, run, tier, {R('start_sec')}, {R('end_sec')} FROM intervals WHERE tier IN ('Q0', 'Q1')")
def poor_intervals(spark, sf):
    return rounded(segments.filter_intervals(intervals(spark, sf), "poor").select("rec", "run", "tier", "start_sec", "end_sec"))


@query("next_poor", f"WITH {INTERVALS} SELECT rec, run, {R('start_sec')}, tier FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_sec, run) AS r FROM intervals WHERE start_sec > 10 AND tier IN ('Q0', 'Q1')) WHERE r = 1")
def next_poor(spark, sf):
    return rounded(segments.next_after(intervals(spark, sf), 10.0).select("rec", "run", "start_sec", "tier"))


@query("segment_at", f"WITH {INTERVALS} SELECT rec, run, tier FROM intervals WHERE start_sec <= 33.0 AND end_sec > 33.0")
def segment_at(spark, sf):
    return segments.segment_at(intervals(spark, sf), 33.0).select("rec", "run", "tier")


@query("segments_in_range", f"WITH {INTERVALS} SELECT rec, run, tier FROM intervals WHERE start_sec < 50 AND end_sec > 30")
def segments_in_range(spark, sf):
    return segments.segments_in_range(intervals(spark, sf), 30, 50).select("rec", "run", "tier")


@query("segment_bands", f"WITH {INTERVALS} SELECT rec, run, tier, round(start_sec / max(end_sec) OVER w, 6) AS at, round((end_sec - start_sec) / max(end_sec) OVER w, 6) AS width FROM intervals WINDOW w AS (PARTITION BY rec)")
def segment_bands(spark, sf):
    return rounded(segments.segment_bands(intervals(spark, sf)))


def union_of(spark, sf):
    return segments.artifact_union(tagged(spark, sf))


@query("artifact_union", f"WITH {TAGGED}, each AS (SELECT rec, run, start_n, unnest(artifacts) AS tag, generate_subscripts(artifacts, 1) AS k FROM tags), firsts AS (SELECT rec, run, tag, min(start_n * 10 + k) AS spot FROM each GROUP BY 1, 2, 3) SELECT i.rec, i.run, coalesce((SELECT string_agg(tag, ';' ORDER BY spot) FROM firsts f WHERE f.rec = i.rec AND f.run = i.run), '') AS artifacts FROM intervals i")
def artifact_union(spark, sf):
    return union_of(spark, sf).withColumn("artifacts", F.array_join("artifacts", ";"))


@query("artifact_bars", f"WITH {TAGGED} SELECT tag, count(*) AS n FROM (SELECT DISTINCT rec, run, unnest(artifacts) AS tag FROM tags) GROUP BY tag")
def artifact_bars(spark, sf):
    return segments.artifact_bars(union_of(spark, sf))


@query("prediction_sets", f"WITH {GRADES}, l AS (SELECT rec, start_n, unnest([0, 1, 2, 3]) AS k, unnest([p0, p1, p2, p3]) AS p FROM grades), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY rec, start_n ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT rec, start_n, string_agg('Q' || k, ';' ORDER BY k) AS members, count(*) >= 2 AS ambiguous FROM c WHERE before < 0.9 - 1e-12 GROUP BY 1, 2")
def prediction_sets(spark, sf):
    found = arrays.prediction_set(F.col("probs"), list(windows.TIERS), 0.9)
    rows = grades(spark, sf).select("rec", "start_n", found.alias("s"))
    return rows.select("rec", "start_n", F.array_join("s", ";").alias("members"), (F.size("s") >= 2).alias("ambiguous"))


@query("sanitized_probabilities", f"WITH {GRADES}, q AS (SELECT rec, start_n, start_n % 3 = 1 AS bad, p0, p1, p2, p3 FROM grades) SELECT rec, start_n, round(CASE WHEN bad THEN 0.25 ELSE p0 END, 6) AS p0, round(CASE WHEN bad THEN 0.0 ELSE greatest(p0, p1, p2, p3) END, 6) AS confidence, CASE WHEN bad THEN 'Q0' ELSE CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 'Q0' WHEN p1 THEN 'Q1' WHEN p2 THEN 'Q2' ELSE 'Q3' END END AS tier FROM q")
def sanitized_probabilities(spark, sf):
    rows = grades(spark, sf)
    broken = F.transform("probs", lambda v, i: F.when((F.col("start_n") % 3 == 1) & (i == 2), F.lit(float("nan"))).otherwise(v))
    rows = windows.graded(rows.withColumn("probs", broken).drop("tier", "confidence", "uncertainty"))
    return rounded(rows.select("rec", "start_n", F.col("probs")[0].alias("p0"), "confidence", "tier"))


@query("artifact_thresholds", f"WITH {GRADES} SELECT rec, start_n, list_aggregate(list_filter([CASE WHEN p1 >= 0.3 THEN 'motion' END, CASE WHEN p2 >= 0.3 THEN 'muscle' END, CASE WHEN p3 >= 0.3 THEN 'wander' END], lambda x: x IS NOT NULL), 'string_agg', ';') AS tags FROM grades WHERE p1 >= 0.3 OR p2 >= 0.3 OR p3 >= 0.3")
def artifact_thresholds(spark, sf):
    tags = arrays.above(F.col("probs"), ["clean", "motion", "muscle", "wander"], 0.3)
    return grades(spark, sf).select("rec", "start_n", tags.alias("t")).filter("size(t) > 0").select("rec", "start_n", F.array_join("t", ";").alias("tags"))


@query("temperature_scaled", f"WITH {GRADES}, z AS (SELECT rec, start_n, ln(greatest(p0, 1e-9)) / 0.4 AS a, ln(greatest(p1, 1e-9)) / 0.4 AS b, ln(greatest(p2, 1e-9)) / 0.4 AS c, ln(greatest(p3, 1e-9)) / 0.4 AS d FROM grades), y AS (SELECT *, greatest(a, b, c, d) AS m FROM z) SELECT rec, start_n, round(exp(d - m) / (exp(a - m) + exp(b - m) + exp(c - m) + exp(d - m) + 1e-12), 6) AS p3 FROM y")
def temperature_scaled(spark, sf):
    return rounded(grades(spark, sf).select("rec", "start_n", arrays.temperature_scale(F.col("probs"), 0.4)[3].alias("p3")))


def recovering(spark, sf):
    """Raw and filtered grades per window: the filtered ones by a rule on the deviation alone."""
    better = F.when(F.col("sd") < 50, F.lit("Q3")).when(F.col("sd") < 60, F.lit("Q2")).otherwise(F.col("tier"))
    rows = grades(spark, sf).withColumn("filtered", better)
    yes = F.col("tier").isin("Q0", "Q1") & F.col("filtered").isin("Q2", "Q3")
    return rows.withColumn("recoverable", yes).withColumn("recovered_tier", F.when(yes, F.col("filtered")).otherwise(""))


RECOVERING = RUNS + """,
rw AS (SELECT *, CASE WHEN sd < 50 THEN 'Q3' WHEN sd < 60 THEN 'Q2' ELSE tier END AS ft FROM numbered),
rv AS (SELECT *, tier IN ('Q0', 'Q1') AND ft IN ('Q2', 'Q3') AS recoverable, CASE WHEN tier IN ('Q0', 'Q1') AND ft IN ('Q2', 'Q3') THEN ft ELSE '' END AS recovered_tier FROM rw)"""


@query("recoverable_windows", f"WITH {RECOVERING} SELECT rec, start_n, recoverable, recovered_tier FROM rv")
def recoverable_windows(spark, sf):
    return recovering(spark, sf).select("rec", "start_n", "recoverable", "recovered_tier")


MAJORITY = RECOVERING + """,
mc AS (SELECT rec, run, recovered_tier, count(*) AS n FROM rv WHERE recoverable GROUP BY 1, 2, 3),
mb AS (SELECT rec, run, recovered_tier FROM (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY n DESC, recovered_tier) AS r FROM mc) WHERE r = 1),
mr AS (SELECT rec, run, avg(CASE WHEN recoverable THEN 1.0 ELSE 0.0 END) >= 0.5 AS recoverable FROM rv GROUP BY 1, 2)"""


@query("recoverable_runs", f"WITH {MAJORITY} SELECT r.rec, r.run, r.recoverable, CASE WHEN r.recoverable THEN coalesce(b.recovered_tier, '') ELSE '' END AS recovered_tier FROM mr r LEFT JOIN mb b ON b.rec = r.rec AND b.run = r.run")
def recoverable_runs(spark, sf):
    rows = recovering(spark, sf)
    return segments.majority(rows, "recoverable", "recovered_tier")


@query("recoverable_share", f"WITH {MAJORITY[: MAJORITY.rindex('mc AS')]} {INTERVALS[len(RUNS) + 2 :]}, mr AS (SELECT rec, run, avg(CASE WHEN recoverable THEN 1.0 ELSE 0.0 END) >= 0.5 AS recoverable FROM rv GROUP BY 1, 2), j AS (SELECT i.rec, i.tier, r.recoverable, end_sec - start_sec AS d FROM intervals i JOIN mr r ON r.rec = i.rec AND r.run = i.run) SELECT rec, CAST(sum(CASE WHEN recoverable THEN 1 ELSE 0 END) AS BIGINT) AS n, round(CASE WHEN sum(CASE WHEN tier IN ('Q0', 'Q1') THEN d ELSE 0 END) > 0 THEN least(1.0, sum(CASE WHEN recoverable THEN d ELSE 0 END) / sum(CASE WHEN tier IN ('Q0', 'Q1') THEN d ELSE 0 END)) ELSE 0 END, 6) AS fraction FROM j GROUP BY rec")
def recoverable_share(spark, sf):
    rows = segments.majority(recovering(spark, sf), "recoverable", "recovered_tier")
    return rounded(segments.recoverable_share(intervals(spark, sf).join(rows, ["rec", "run"])))


BIN = 4

BADNESS = INTERVALS + f""",
base AS (SELECT rec, quantile_cont(x, 0.5) AS med, max(abs(x)) AS top, count(*) AS len FROM samples GROUP BY rec),
devs AS (SELECT s.rec, s.n, s.x, abs(s.x - b.med) AS dev, b.top, b.len // {BIN} AS nb FROM samples s JOIN base b ON b.rec = s.rec),
scales AS (SELECT rec, quantile_cont(dev, 0.99) AS scale FROM devs GROUP BY rec),
bins AS (SELECT rec, n // {BIN} AS b, nb, max(dev) AS peak, var_pop(x) AS v, avg(CASE WHEN abs(x) > 0.98 * (CASE WHEN top = 0 THEN 1e-9 ELSE top END) THEN 1.0 ELSE 0.0 END) AS clip FROM devs WHERE n // {BIN} < nb GROUP BY 1, 2, 3),
usual AS (SELECT rec, quantile_cont(v, 0.5) + 1e-12 AS u FROM bins GROUP BY rec),
badness AS (SELECT b.rec, b.b, b.nb, peak > 1.5 * (CASE WHEN scale = 0 THEN 1e-9 ELSE scale END) OR v < 1e-3 * u OR clip > 0.30 AS bad FROM bins b JOIN scales s ON s.rec = b.rec JOIN usual u ON u.rec = b.rec)"""


@query("fine_badness", f"WITH {BADNESS.replace('peak > 1.5', 'peak > 0.9')} SELECT rec, b, bad FROM badness")
def fine_badness(spark, sf):
    return refine.fine_badness(samples(spark, sf), BIN, 0.9).select("rec", "b", "bad")


REFINED = BADNESS.replace("peak > 1.5", "peak > 3.0") + f""",
rk AS (SELECT *, CAST(substr(tier, 2, 1) AS INT) AS rank FROM intervals),
wv AS (SELECT * FROM (SELECT b.rec, b.b, i.tier, i.confidence, row_number() OVER (PARTITION BY b.rec, b.b ORDER BY i.rank, i.start_sec) AS r FROM badness b JOIN rk i ON i.rec = b.rec AND i.start_sec < (b.b + 1) * {BIN} - 1e-9 AND i.end_sec > b.b * {BIN} + 1e-9) WHERE r = 1),
cv AS (SELECT * FROM (SELECT b.rec, b.b, g.tier AS ct, g.confidence AS cc, row_number() OVER (PARTITION BY b.rec, b.b ORDER BY g.tier DESC, g.start_n) AS r FROM badness b JOIN grades g ON g.rec = b.rec AND g.start_n <= b.b * {BIN} + 1e-9 AND g.start_n + {LENGTH} >= (b.b + 1) * {BIN} - 1e-9) WHERE r = 1),
fb AS (SELECT b.rec, b.b, b.nb, b.bad, w.tier, w.confidence, c.ct, c.cc, coalesce(w.tier IN ('Q0', 'Q1'), false) AS poor, coalesce(c.ct > w.tier, false) AS may FROM badness b LEFT JOIN wv w ON w.rec = b.rec AND w.b = b.b LEFT JOIN cv c ON c.rec = b.rec AND c.b = b.b),
fr AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY b) AS pr FROM (SELECT *, CASE WHEN lag(poor) OVER (PARTITION BY rec ORDER BY b) = poor THEN 0 ELSE 1 END AS nw FROM fb)),
fc AS (SELECT *, greatest(min(b) OVER p, min(CASE WHEN bad THEN b END) OVER p - 1) AS c0, least(max(b) OVER p, max(CASE WHEN bad THEN b END) OVER p + 1) AS c1, min(CASE WHEN bad THEN b END) OVER p AS fbad,
  bool_and(may) OVER (PARTITION BY rec, pr ORDER BY b) AS ahead, bool_and(may) OVER (PARTITION BY rec, pr ORDER BY b DESC) AS behind FROM fr WINDOW p AS (PARTITION BY rec, pr)),
fx AS (SELECT *, poor AND fbad IS NOT NULL AND ((b < c0 AND ahead) OR (b > c1 AND behind)) AS relaxed FROM fc),
fy AS (SELECT rec, b, nb, relaxed, CASE WHEN relaxed THEN ct ELSE tier END AS tier, CASE WHEN relaxed THEN tier ELSE '' END AS model_tier, CASE WHEN relaxed THEN cc ELSE confidence END AS confidence FROM fx),
ch AS (SELECT rec, bool_or(relaxed) AS changed, max(nb) * {BIN} AS grid_end FROM fy GROUP BY rec),
fz AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY b) AS r2 FROM (SELECT *, CASE WHEN lag(tier) OVER w IS NOT DISTINCT FROM tier AND lag(model_tier) OVER w = model_tier THEN 0 ELSE 1 END AS nw FROM fy WINDOW w AS (PARTITION BY rec ORDER BY b))),
fine AS (SELECT rec, CAST(min(b) * {BIN} AS DOUBLE) AS start_sec, CAST((max(b) + 1) * {BIN} AS DOUBLE) AS end_sec, min(tier) AS tier, min(model_tier) AS model_tier, avg(confidence) AS confidence FROM fz WHERE tier IS NOT NULL GROUP BY rec, r2),
rest AS (SELECT i.rec, greatest(i.start_sec, c.grid_end) AS start_sec, i.end_sec, i.tier, '' AS model_tier, i.confidence FROM intervals i JOIN ch c ON c.rec = i.rec WHERE c.changed AND i.end_sec > greatest(i.start_sec, c.grid_end) + 1e-9),
bo AS (SELECT f.* FROM fine f JOIN ch c ON c.rec = f.rec WHERE c.changed UNION ALL SELECT * FROM rest),
bn AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY start_sec) AS r3 FROM (SELECT *, CASE WHEN lag(tier) OVER w = tier AND lag(model_tier) OVER w = '' AND model_tier = '' AND abs(lag(end_sec) OVER w - start_sec) < 1e-9 THEN 0 ELSE 1 END AS nw FROM bo WINDOW w AS (PARTITION BY rec ORDER BY start_sec))),
refined AS (SELECT rec, min(start_sec) AS start_sec, max(end_sec) AS end_sec, min(tier) AS tier, min(model_tier) AS model_tier, arg_min(confidence, start_sec) AS confidence FROM bn GROUP BY rec, r3
  UNION ALL SELECT i.rec, i.start_sec, i.end_sec, i.tier, '', i.confidence FROM intervals i LEFT JOIN ch c ON c.rec = i.rec WHERE NOT coalesce(c.changed, false))"""


@query("refined_intervals", f"WITH {REFINED.replace('peak > 3.0', 'peak > 0.9')} SELECT rec, {R('start_sec')}, {R('end_sec')}, tier, model_tier, {R('confidence')} FROM refined")
def refined_intervals(spark, sf):
    return rounded(refine.refine(intervals(spark, sf), grades(spark, sf), samples(spark, sf), LENGTH, BIN, excess=0.9))


@query("worst_overlap", f"WITH {INTERVALS}, sp AS (SELECT rec, (k * 10.0)::DOUBLE AS lo, (k * 10.0 + 25.0)::DOUBLE AS hi FROM lens, range(0, 6) r(k)) SELECT s.rec, lo, hi, min(i.tier) AS worst, count(*) AS n FROM sp s JOIN intervals i ON i.rec = s.rec AND i.start_sec < hi AND i.end_sec > lo GROUP BY 1, 2, 3")
def worst_overlap(spark, sf):
    spans = windows.lengths(samples(spark, sf)).select("rec", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    spans = spans.select("rec", (F.col("k") * 10.0).cast("double").alias("lo"), (F.col("k") * 10.0 + 25.0).cast("double").alias("hi"))
    pairs = segments.overlap_join(intervals(spark, sf), spans, 16.0)
    return pairs.groupBy("rec", "lo", "hi").agg(F.min("tier").alias("worst"), F.count("*").alias("n"))


COMPLETENESS = "c0 AS (SELECT *, x IS NOT NULL AS ok, min(x) OVER (PARTITION BY rec) AS lo, max(x) OVER (PARTITION BY rec) AS hi FROM flawed), c1 AS (SELECT *, NOT ok OR x = 0 AS bad, ok AND hi > lo AND (x >= lo + 0.999 * (hi - lo) OR x <= hi - 0.999 * (hi - lo)) AS rail FROM c0), c2 AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY n) AS run FROM (SELECT *, CASE WHEN lag(bad) OVER (PARTITION BY rec ORDER BY n) = bad THEN 0 ELSE 1 END AS nw FROM c1)), c3 AS (SELECT rec, run, bad, count(*) AS size, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS missing, sum(CASE WHEN rail THEN 1 ELSE 0 END) AS rail FROM c2 GROUP BY 1, 2, 3), comp AS (SELECT rec, CAST(sum(size) AS BIGINT) AS n_samples, round(sum(missing) / sum(size), 6) AS missing_frac, round(sum(rail) / sum(size), 6) AS clipping_frac, CAST(sum(CASE WHEN bad AND size >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_dropout_gaps, round(max(CASE WHEN bad THEN size ELSE 0 END) / 8.0, 6) AS longest_gap_s, round(greatest(0.0, 1 - sum(CASE WHEN bad AND size >= 4 THEN size ELSE missing END) / sum(size)), 6) AS completeness FROM c3 GROUP BY rec)"


@query("completeness", f"WITH {FLAWED}, {COMPLETENESS} SELECT * FROM comp")
def completeness(spark, sf):
    return rounded(quality.completeness(tables.flawed(samples(spark, sf)), 8.0))


@query("record_quality", f"WITH {FLAWED}, {COMPLETENESS}, {flat_rows('flawed', 8)}, ff AS (SELECT rec, avg(CASE WHEN flat THEN 1.0 ELSE 0.0 END) AS f FROM flats GROUP BY 1) SELECT c.*, round(f, 6) AS flatline_frac, n_samples / 8.0 AS duration_s, concat_ws('; ', CASE WHEN missing_frac > 0.01 THEN CAST(round_even(missing_frac * 100, 0) AS INT) || '% missing/NaN samples' END, CASE WHEN f > 0.2 THEN CAST(round_even(f * 100, 0) AS INT) || '% flatline (dead/disconnected sensor?)' END, CASE WHEN clipping_frac > 0.05 THEN CAST(round_even(clipping_frac * 100, 0) AS INT) || '% clipped/saturated (gain too high?)' END, CASE WHEN n_dropout_gaps > 0 THEN n_dropout_gaps || ' dropout gap(s), longest ' || printf('%.1f', longest_gap_s) || 's' END) AS flags, completeness >= 0.9 AND f < 0.5 AND clipping_frac < 0.5 AS usable FROM comp c JOIN ff ON ff.rec = c.rec")
def record_quality(spark, sf):
    rows = quality.record_quality(tables.flawed(samples(spark, sf)), 8.0)
    return rounded(rows.withColumn("flags", F.array_join("flags", "; ")))


@query("sustained_runs", f"WITH {SAMPLES}, f AS (SELECT rec, n, x < 40 AS low FROM samples), g AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY n) AS run FROM (SELECT *, CASE WHEN lag(low) OVER (PARTITION BY rec ORDER BY n) = low THEN 0 ELSE 1 END AS nw FROM f)) SELECT rec, n, low AND count(*) OVER (PARTITION BY rec, run) >= 3 AS low FROM g")
def sustained_runs(spark, sf):
    return segments.sustained(samples(spark, sf).select("rec", "n", (F.col("x") < 40).alias("low")), "low", 3)


@query("pyramid", f"WITH {SAMPLES}, f AS (SELECT unnest([1, 8, 64, 512, 4096]) AS factor) SELECT s.rec, factor, n // factor AS bin, min(x) AS y_min, max(x) AS y_max FROM samples s JOIN lens l ON l.rec = s.rec, f WHERE factor <= len GROUP BY 1, 2, 3")
def pyramid_levels(spark, sf):
    return pyramid.pyramid(samples(spark, sf))


@query("pyramid_slice", f"WITH {SAMPLES} SELECT s.rec, 8 AS factor, n // 8 AS bin, min(x) AS y_min, max(x) AS y_max FROM samples s WHERE n // 8 >= 2 AND n // 8 < 5 GROUP BY 1, 3")
def pyramid_slice(spark, sf):
    levels = pyramid.pyramid(samples(spark, sf), (1, 8))
    return pyramid.level_slice(levels, pyramid.select_level(10.0), 16, 40)


ENVELOPE = "SELECT DISTINCT rec, n, x FROM (SELECT *, row_number() OVER (PARTITION BY rec, bucket ORDER BY x, n) AS a, row_number() OVER (PARTITION BY rec, bucket ORDER BY x DESC, n) AS b FROM (SELECT rec, n, x, n // {w} AS bucket FROM samples{where})) WHERE a = 1 OR b = 1"


@query("envelope", f"WITH {SAMPLES} {ENVELOPE.format(w=7, where='')}")
def envelope(spark, sf):
    return pyramid.envelope(samples(spark, sf), pyramid.samples_per_bucket(70, 20))


@query("curve_for_range", f"WITH {SAMPLES} {ENVELOPE.format(w=4, where=' WHERE n >= 10 AND n < 42')}")
def curve_for_range(spark, sf):
    return pyramid.curve_for_range(samples(spark, sf), 10, 42, 8)


@query("robust_range", f"WITH {SAMPLES} SELECT rec, round(quantile_cont(x, 0.005), 6) AS lo, round(quantile_cont(x, 0.995), 6) AS hi FROM samples GROUP BY rec")
def robust_range(spark, sf):
    return rounded(pyramid.robust_range(samples(spark, sf)))


@query("value_at", f"WITH {SAMPLES} SELECT rec, n, x FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY CASE WHEN n >= 55.5 THEN 0 ELSE 1 END, abs(n - 55.5)) AS r FROM samples) WHERE r = 1")
def value_at(spark, sf):
    return pyramid.value_at(samples(spark, sf), 55.5)


@query("moved_boundary", f"WITH {INTERVALS}, m AS (SELECT *, CASE WHEN run = 1 AND lead(end_sec) OVER w IS NOT NULL THEN greatest(start_sec + 0.1, least(lead(end_sec) OVER w - 0.1, end_sec + 100.0)) END AS mv FROM intervals WINDOW w AS (PARTITION BY rec ORDER BY run)) SELECT rec, run, tier, round(coalesce(lag(mv) OVER w, start_sec), 6) AS start_sec, round(coalesce(mv, end_sec), 6) AS end_sec FROM m WINDOW w AS (PARTITION BY rec ORDER BY run)")
def moved_boundary(spark, sf):
    rows = intervals(spark, sf)
    moves = rows.filter("run = 1").select("rec", "run", (F.col("end_sec") + 100.0).alias("to"))
    return rounded(review.move_boundary(rows, moves).select("rec", "run", "tier", "start_sec", "end_sec"))


@query("split_intervals", f"WITH {INTERVALS}, c AS (SELECT *, list_concat([start_sec], list_filter([20.0, 30.0, 45.0], lambda t: t > start_sec + 0.1 AND t < end_sec - 0.1), [end_sec]) AS cuts FROM intervals), p AS (SELECT *, unnest(range(1, len(cuts))) AS k FROM c) SELECT rec, run, tier, CAST(k - 1 AS INT) AS part, round(cuts[k], 6) AS start_sec, round(cuts[k + 1], 6) AS end_sec FROM p")
def split_intervals(spark, sf):
    """Several cuts a recording, two of them too near each other."""
    times = F.array(*map(F.lit, (45.0, 20.0, 20.05, 30.0)))
    at = windows.lengths(samples(spark, sf)).select("rec", F.explode(times).alias("t"))
    return rounded(review.split(intervals(spark, sf), at).select("rec", "run", "tier", "part", "start_sec", "end_sec"))


@query("merged_intervals", f"WITH {INTERVALS}, g AS (SELECT *, sum(CASE WHEN run - 1 IN (0, 1, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY run) AS grp FROM intervals) SELECT rec, min(run) AS run, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, arg_min(tier, (-(end_sec - start_sec)) * 1000 + run) AS tier, round(arg_min(confidence, (-(end_sec - start_sec)) * 1000 + run), 6) AS confidence FROM g GROUP BY rec, grp")
def merged_intervals(spark, sf):
    """Neighbours that are both chosen become one."""
    rows = intervals(spark, sf)
    return rounded(review.merge_next(rows, rows.filter("run in (0, 1, 3)").select("rec", "run")))


@query("view_slice", f"WITH {SAMPLES} {ENVELOPE.format(w=5, where=' WHERE n >= 15 AND n < 65')}")
def view_slice(spark, sf):
    return pyramid.view(samples(spark, sf), 20, 60, 8)


@query("span_samples", f"WITH {INTERVALS} SELECT s.rec, s.n, round(s.x, 6) AS x FROM samples s JOIN intervals i ON i.rec = s.rec AND i.run = 0 WHERE s.n >= floor(i.start_sec) AND s.n < greatest(floor(i.start_sec) + 1, floor(i.end_sec))")
def span_samples(spark, sf):
    return rounded(segments.span_samples(samples(spark, sf), intervals(spark, sf).filter("run = 0"), 1.0))


@query("discordant_intervals", f"WITH {INTERVALS}, c AS (SELECT *, CASE WHEN run % 5 = 0 THEN -1 ELSE confidence - 0.2 END AS consensus FROM intervals) SELECT rec, run, tier IN ('Q2', 'Q3') AND consensus >= 0 AND consensus < 0.5 AS discordant FROM c")
def discordant_intervals(spark, sf):
    rows = intervals(spark, sf).withColumn("consensus", F.when(F.col("run") % 5 == 0, -1.0).otherwise(F.col("confidence") - 0.2))
    return segments.discordant(rows).select("rec", "run", "discordant")


@query("rationales", f"WITH {INTERVALS} SELECT rec, run, 'grade ' || tier || ' | confidence ' || printf('%.2f', confidence) || ' | ' || printf('%.1f', end_sec - start_sec) || ' s' AS rationale FROM intervals")
def rationales(spark, sf):
    none = F.array().cast("array<string>")
    text = segments.rationale(F.col("tier"), F.col("confidence"), F.col("end_sec") - F.col("start_sec"), none)
    return intervals(spark, sf).select("rec", "run", text.alias("rationale"))


@query("routed_recordings", f"WITH {SAMPLES} SELECT rec, len, 2 * len AS work, CASE WHEN 2 * len >= 130 THEN 'stream' ELSE 'batch' END AS route FROM lens")
def routed_recordings(spark, sf):
    return windows.routed(windows.lengths(samples(spark, sf)), True, 130)


@query("offered_overlaps", f"WITH {SAMPLES} SELECT rec, CASE WHEN o <= 0.125 THEN 0.0 WHEN o <= 0.375 THEN 0.25 WHEN o <= 0.625 THEN 0.5 ELSE 0.75 END::DOUBLE AS overlap FROM (SELECT rec, (len % 10) / 10.0 AS o FROM lens)")
def offered_overlaps(spark, sf):
    return windows.lengths(samples(spark, sf)).select("rec", windows.offered_overlap((F.col("len") % 10) / 10.0).alias("overlap"))


@query("normalized_zscore", f"WITH {STARTS}, s AS (SELECT t.rec, t.start_n, s.n - t.start_n AS pos, x FROM starts t JOIN samples s ON s.rec = t.rec AND s.n >= t.start_n AND s.n < t.start_n + {LENGTH}) SELECT rec, start_n, CAST(pos AS INT) AS pos, round(CASE WHEN stddev_pop(x) OVER w > 1e-8 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END, 6) AS x FROM s WINDOW w AS (PARTITION BY rec, start_n)")
def normalized_zscore(spark, sf):
    rows = windows.windowed(samples(spark, sf), LENGTH, STEP)
    held = rows.groupBy("rec", "start_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("w"))
    return rounded(windows.normalized(held, "zscore").select("rec", "start_n", F.posexplode("w").alias("pos", "x")))


@query("flat_samples", f"WITH {FLAWED}, {flat_rows('flawed', 8)} SELECT rec, n, flat FROM flats")
def flat_samples(spark, sf):
    return quality.flat_samples(tables.flawed(samples(spark, sf)), 8.0)


@query("flatline_of_still_recordings", f"WITH {SAMPLES}, calm AS (SELECT rec, n, CASE WHEN rec % 3 = 0 AND n >= 4 THEN 7.0 WHEN rec % 3 = 1 AND n % 2 = 0 THEN x / 100 ELSE x END AS x FROM samples), {flat_rows('calm', 8)} SELECT rec, round(avg(CASE WHEN flat THEN 1.0 ELSE 0.0 END), 6) AS flatline_frac FROM flats GROUP BY 1")
def flatline_of_still_recordings(spark, sf):
    """Recordings that stand still from some sample on, that alternate, and that do neither."""
    x = F.when((F.col("rec") % 3 == 0) & (F.col("n") >= 4), 7.0).when((F.col("rec") % 3 == 1) & (F.col("n") % 2 == 0), F.col("x") / 100).otherwise(F.col("x"))
    return rounded(quality.flatline(samples(spark, sf).select("rec", "n", x.alias("x")), 8.0))


REVIEWS = INTERVALS + """,
rvw AS (SELECT rec, CAST(round_even(start_sec * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(end_sec * 1000, 0) AS BIGINT) AS end_ms, CASE WHEN (rec + run) % 2 = 0 THEN 'Q0' END AS new_tier, CASE WHEN run % 2 = 0 THEN '=seen ' || run END AS note FROM intervals WHERE (rec + run) % 3 = 0)"""


def reviews(spark, sf):
    """Reviews of every third interval, as two actions each of which the later fills in."""
    rows = intervals(spark, sf).filter("(rec + run) % 3 = 0")
    acts = F.array(F.struct(F.lit(0).alias("seq"), F.lit("Q1").alias("t"), F.lit(None).cast("string").alias("nt")), F.struct(F.lit(1).alias("seq"), F.when((F.col("rec") + F.col("run")) % 2 == 0, F.lit("Q0")).alias("t"), F.when(F.col("run") % 2 == 0, F.concat(F.lit("=seen "), F.col("run").cast("string"))).alias("nt")))
    rows = rows.withColumn("a", F.explode(acts)).select(F.col("rec").alias("recording"), "start_sec", "end_sec", "a.seq", F.col("tier").alias("orig"), F.when((F.col("rec") + F.col("run")) % 2 == 0, F.col("a.t")).alias("new_tier"), F.col("a.nt").alias("note"))
    return review.upsert_reviews(rows).withColumnRenamed("recording", "rec")


@query("reviews", f"WITH {REVIEWS} SELECT rec, start_ms, end_ms, new_tier, note FROM rvw")
def review_log(spark, sf):
    return reviews(spark, sf).select("rec", "start_ms", "end_ms", "new_tier", "note")


@query("never_reviewed", f"WITH {INTERVALS} SELECT rec, run FROM intervals WHERE (rec + run) % 3 <> 0")
def never_reviewed(spark, sf):
    return review.never_reviewed(intervals(spark, sf), reviews(spark, sf)).select("rec", "run")


@query("reclassified", f"WITH {INTERVALS} SELECT rec, run, CASE WHEN run % 2 = 0 THEN 'Q0' ELSE tier END AS tier, CASE WHEN run % 2 = 0 THEN tier ELSE '' END AS model_tier FROM intervals")
def reclassified(spark, sf):
    rows = intervals(spark, sf).withColumn("model_tier", F.lit(""))
    chosen = rows.filter("run % 2 = 0").select("rec", "run", F.lit("Q0").alias("new_tier"))
    return review.reclassify(rows, chosen).select("rec", "run", "tier", "model_tier")


@query("interval_records", f"WITH {REVIEWS} SELECT i.rec, round(i.start_sec, 4) AS start_sec, round(i.end_sec, 4) AS end_sec, coalesce(r.new_tier, i.tier) AS tier, i.tier AS model_tier, round(i.confidence, 4) AS confidence, coalesce(r.new_tier <> i.tier, false) AS overridden, coalesce(CASE WHEN r.note LIKE '=%' THEN '''' || r.note ELSE r.note END, '') AS note FROM intervals i LEFT JOIN rvw r ON r.rec = i.rec AND r.start_ms = CAST(round_even(i.start_sec * 1000, 0) AS BIGINT) AND r.end_ms = CAST(round_even(i.end_sec * 1000, 0) AS BIGINT)")
def interval_records(spark, sf):
    rows = review.interval_records(intervals(spark, sf).withColumn("model_tier", F.lit("")), reviews(spark, sf))
    return rows.withColumn("note", review.safe_cell(F.col("note")))


RUN_FIGURES = TAGGED + REVIEWS[len(INTERVALS) :] + """,
fl AS (SELECT *, start_n % 3 = 0 AS recoverable, 'Q' || (2 + start_n // 16 % 2) AS recovered_tier, hi >= 150 AS rate_usable, CAST(60 + start_n % 40 AS DOUBLE) AS hr FROM numbered),
fm AS (SELECT rec, run, avg(CASE WHEN recoverable THEN 1 ELSE 0 END) >= 0.5 AS recoverable, avg(CASE WHEN rate_usable THEN 1 ELSE 0 END) >= 0.5 AS rate_usable, quantile_cont(CASE WHEN rate_usable THEN hr END, 0.5) AS hr FROM fl GROUP BY 1, 2),
ft AS (SELECT rec, run, recovered_tier AS v, row_number() OVER (PARTITION BY rec, run ORDER BY count(*) DESC, recovered_tier) AS r FROM fl WHERE recoverable GROUP BY 1, 2, 3),
fp AS (SELECT rec, run, unnest([0, 1, 2, 3]) AS k, unnest([avg(p0), avg(p1), avg(p2), avg(p3)]) AS p FROM numbered GROUP BY rec, run),
fb AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY rec, run ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fp),
fs AS (SELECT rec, run, string_agg('Q' || k, ';' ORDER BY k) AS members FROM fb WHERE before < 0.9 - 1e-12 GROUP BY 1, 2),
fu AS (SELECT rec, run, unnest(artifacts) AS tag, start_n * 10 + unnest(range(len(artifacts))) AS pos FROM tags),
fa AS (SELECT rec, run, string_agg(tag, ';' ORDER BY pos) AS artifacts FROM (SELECT rec, run, tag, min(pos) AS pos FROM fu GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("export_rows", f"WITH {RUN_FIGURES} SELECT i.rec, round(i.start_sec, 6) AS start_sec, round(i.end_sec, 6) AS end_sec, coalesce(r.new_tier, i.tier) AS tier, i.tier AS model_tier, round(i.confidence, 6) AS confidence, coalesce(fa.artifacts, '') AS artifacts, r.new_tier IS NOT NULL AS overridden, coalesce(CASE WHEN r.note LIKE '=%' THEN '''' || r.note ELSE r.note END, '') AS note, fm.recoverable, CASE WHEN fm.recoverable THEN coalesce(ft.v, '') ELSE '' END AS recovered_tier, round(i.uncertainty, 4) AS uncertainty, fm.rate_usable, CASE WHEN fm.rate_usable THEN round(fm.hr, 1) ELSE 0.0::DOUBLE END AS hr_bpm, fs.members AS conformal_set, 'II' AS channel FROM intervals i JOIN fm ON fm.rec = i.rec AND fm.run = i.run JOIN fs ON fs.rec = i.rec AND fs.run = i.run LEFT JOIN ft ON ft.rec = i.rec AND ft.run = i.run AND ft.r = 1 LEFT JOIN fa ON fa.rec = i.rec AND fa.run = i.run LEFT JOIN rvw r ON r.rec = i.rec AND r.start_ms = CAST(round_even(i.start_sec * 1000, 0) AS BIGINT) AND r.end_ms = CAST(round_even(i.end_sec * 1000, 0) AS BIGINT)")
def export_rows(spark, sf):
    """Intervals with all that their runs carry, as tables of intervals are written."""
    n = F.col("start_n")
    rows = tagged(spark, sf).withColumn("recoverable", n % 3 == 0).withColumn("recovered_tier", F.concat(F.lit("Q"), (2 + F.floor(n / 16) % 2).cast("string")))
    rows = rows.withColumn("rate_usable", F.col("hi") >= 150).withColumn("hr_bpm", 60.0 + n % 40)
    out = review.export_rows(segments.run_figures(rows, LENGTH, 0.9), reviews(spark, sf), "II")
    lists = {c: F.array_join(c, ";") for c in ("artifacts", "conformal_set")}
    return rounded(out.withColumns(lists).withColumn("note", review.safe_cell(F.col("note"))))
