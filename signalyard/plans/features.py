"""Queries over window vectors: features that SQL can say, and kernels that need arrays."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, kernels, research, usability
from ..operators import explain, quality
from ..operators.ranges import running_sums
from ..sources import tables
from .sql import SAMPLES, VECTORS, Z, flat_rows
from .views import rounded, samples, standardized, vectors

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


def batched(rows: DataFrame, fn, names: list[str], keys: tuple[str, ...] = ("vec_id",), column: str = "w") -> DataFrame:
    """fn over Arrow batches of windows: it gets a matrix and returns a column per name."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                found = fn(np.stack(f[column].to_list()).astype(float))
                yield pd.concat([f[list(keys)].reset_index(drop=True), pd.DataFrame({n: found[n] for n in names})], axis=1)

    return rows.select(*keys, column).mapInPandas(run, schema)


NAMES = {m: list(f(kernels.Batch(np.zeros((1, 64)), 64.0))) for m, f in kernels.PACKS.items()}


@query("moments", f"WITH {Z} SELECT vec_id, round(avg(z * z * z), 6) AS skew, round(avg(z * z * z * z) - 3, 6) AS excess FROM zs GROUP BY vec_id")
def moments(spark, sf):
    z = standardized(spark, sf)
    cube, four = F.transform("z", lambda v: v * v * v), F.transform("z", lambda v: v * v * v * v)
    return rounded(z.select("vec_id", arrays.mean(cube).alias("skew"), (arrays.mean(four) - 3).alias("excess")))


HAAR = Z + """,
h1 AS (SELECT vec_id, i // 2 AS k, sum(z) / sqrt(2) AS a, sum(CASE WHEN i % 2 = 0 THEN z ELSE -z END) / sqrt(2) AS d FROM zs GROUP BY 1, 2),
h2 AS (SELECT vec_id, k // 2 AS k, sum(a) / sqrt(2) AS a, sum(CASE WHEN k % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d FROM h1 GROUP BY 1, 2),
en AS (SELECT vec_id, sum(z * z) + 1e-8 AS e FROM zs GROUP BY 1)"""


@query("haar_levels", f"WITH {HAAR}, l AS (SELECT vec_id, 1 AS level, d, a FROM h1 UNION ALL SELECT vec_id, 2, d, a FROM h2) SELECT l.vec_id, level, round(stddev_pop(d), 6) AS std, round(max(abs(d)), 6) AS top, round(sum(d * d) / max(e), 6) AS eratio FROM l JOIN en ON en.vec_id = l.vec_id GROUP BY 1, 2")
def haar_levels(spark, sf):
    rows = standardized(spark, sf).withColumn("e", arrays.total(F.transform("z", lambda v: v * v)) + 1e-8).withColumn("a", F.col("z"))
    out = None
    for level in (1, 2):
        a, d = arrays.haar(F.col("a"))
        rows = rows.withColumn("d", d).withColumn("a", a)
        mid = arrays.mean(F.col("d"))
        energy = arrays.total(F.transform("d", lambda v: v * v))
        std = F.sqrt(F.greatest(F.lit(0.0), energy / F.size("d") - mid * mid))
        one = rows.select("vec_id", F.lit(level).alias("level"), std.alias("std"), F.array_max(F.transform("d", F.abs)).alias("top"), (energy / F.col("e")).alias("eratio"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("jump_ratio", f"WITH {Z}, d AS (SELECT vec_id, i, z - lag(z) OVER w AS d FROM zs WINDOW w AS (PARTITION BY vec_id ORDER BY i)), p AS (SELECT *, abs(d * lag(d) OVER (PARTITION BY vec_id ORDER BY i)) AS q FROM d), s AS (SELECT vec_id, sum(d * d) + 1e-8 AS rv, pi() / 2 * sum(q) AS bv FROM p GROUP BY 1) SELECT vec_id, round(greatest(rv - bv, 0) / rv, 6) AS jump_ratio, round(bv / rv, 6) AS bv_rv_ratio FROM s")
def jump_ratio(spark, sf):
    rows = standardized(spark, sf).withColumn("d", arrays.diff(F.col("z")))
    rv = arrays.total(F.transform("d", lambda v: v * v)) + 1e-8
    pairs = F.zip_with(F.slice("d", 2, 62), F.slice("d", 1, 62), lambda a, b: F.abs(a * b))
    rows = rows.withColumn("rv", rv).withColumn("bv", np.pi / 2 * arrays.total(pairs))
    return rounded(rows.select("vec_id", (F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)) / F.col("rv")).alias("jump_ratio"), (F.col("bv") / F.col("rv")).alias("bv_rv_ratio")))


@query("dispersion_entropy", f"WITH {Z}, c AS (SELECT vec_id, i, least(6, greatest(1, ceil(6 / (1 + exp(-1.702 * z))))) - 1 AS c FROM zs), p AS (SELECT vec_id, c + 6 * lead(c) OVER (PARTITION BY vec_id ORDER BY i) AS code FROM c), n AS (SELECT vec_id, code, count(*) / 63.0 AS q FROM p WHERE code IS NOT NULL GROUP BY 1, 2) SELECT vec_id, round(-sum(q * ln(q)) / ln(36), 6) AS disp_ent FROM n GROUP BY 1")
def dispersion_entropy(spark, sf):
    level = lambda v: F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(6 / (1 + F.exp(-1.702 * v))))) - 1
    rows = standardized(spark, sf).withColumn("c", F.transform("z", level))
    codes = F.zip_with(F.slice("c", 1, 63), F.slice("c", 2, 63), lambda a, b: a + 6 * b)
    counts = rows.select("vec_id", F.explode(codes).alias("code")).groupBy("vec_id", "code").agg((F.count("*") / 63.0).alias("q"))
    return rounded(counts.groupBy("vec_id").agg((-F.sum(F.col("q") * F.ln("q")) / F.ln(F.lit(36.0))).alias("disp_ent")))


@query("ordinal_patterns", f"WITH {Z}, w AS (SELECT vec_id, i, z AS a, lead(z) OVER o AS b, lead(z, 2) OVER o AS c FROM zs WINDOW o AS (PARTITION BY vec_id ORDER BY i)), p AS (SELECT vec_id, i, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN b <= c AND c < a THEN 3 WHEN c < a AND a <= b THEN 4 ELSE 5 END AS code FROM w WHERE c IS NOT NULL), t AS (SELECT *, lag(code) OVER (PARTITION BY vec_id ORDER BY i) AS prev FROM p), n AS (SELECT vec_id, code, count(*) / 62.0 AS q FROM p GROUP BY 1, 2), e AS (SELECT vec_id, 1 - count(*) / 6.0 AS forbidden, -sum(q * ln(q)) / ln(6) AS ent FROM n GROUP BY 1), s AS (SELECT vec_id, avg(CASE WHEN prev = code THEN 1.0 ELSE 0.0 END) AS self FROM t WHERE prev IS NOT NULL GROUP BY 1) SELECT e.vec_id, round(forbidden, 6) AS op_forbidden, round(self, 6) AS op_self_trans, round(ent, 6) AS op_trans_ent FROM e JOIN s ON s.vec_id = e.vec_id")
def ordinal_patterns(spark, sf):
    fn = lambda x: kernels.Batch(x, 64.0).ordinal()
    return rounded(batched(vectors(spark, sf), fn, ["op_forbidden", "op_self_trans", "op_trans_ent"]))


@query("lagged_correlation", f"WITH {Z}, l AS (SELECT vec_id, z, lead(z, 5) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM zs) SELECT vec_id, round(sum(z * y) / (sum(z * z) + 1e-8), 6) AS r5 FROM l GROUP BY 1")
def lagged_correlation(spark, sf):
    pairs = F.zip_with(F.slice("z", 1, 59), F.slice("z", 6, 59), lambda a, b: a * b)
    energy = arrays.total(F.transform("z", lambda v: v * v)) + 1e-8
    return rounded(standardized(spark, sf).select("vec_id", (arrays.total(pairs) / energy).alias("r5")))


DFT = Z + """,
hn AS (SELECT vec_id, i, z * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS y FROM zs),
sp AS (SELECT vec_id, k, pow(sum(y * cos(2 * pi() * k * i / 64)), 2) + pow(sum(y * sin(2 * pi() * k * i / 64)), 2) AS p FROM hn, range(0, 33) r(k) GROUP BY 1, 2)"""


@query("band_ratios", f"WITH {DFT}, t AS (SELECT vec_id, sum(CASE WHEN k >= 0.5 AND k < 32 THEN p ELSE 0 END) + 1e-8 AS total, sum(CASE WHEN k >= 0.5 AND k < 8 THEN p ELSE 0 END) AS low, sum(CASE WHEN k >= 20 AND k < 32 THEN p ELSE 0 END) AS high FROM sp GROUP BY 1) SELECT vec_id, round(low / total, 6) AS low_ratio, round(high / total, 6) AS high_ratio FROM t")
def band_ratios(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        found = kernels.eeg_pack(kernels.Batch(x, 64.0))
        return {"low_ratio": found["eeg_low_ratio"], "high_ratio": found["eeg_high_ratio"]}

    return rounded(batched(vectors(spark, sf), fn, ["low_ratio", "high_ratio"]))


SPECTRAL = DFT + ", f AS (SELECT *, p + 1e-8 AS q FROM sp WHERE k >= 20 AND k < 32)"


@query("spectral_flatness", f"WITH {SPECTRAL} SELECT vec_id, round(exp(avg(ln(q))) / (avg(q) + 1e-8), 6) AS flatness FROM f GROUP BY 1")
def spectral_flatness(spark, sf):
    return rounded(batched(vectors(spark, sf), lambda x: {"flatness": kernels.Batch(x, 64.0).flatness(20, 32)}, ["flatness"]))


@query("spectral_slope", f"WITH {DFT}, l AS (SELECT vec_id, ln(k + 1e-8) AS u, ln(p + 1e-8) AS v FROM sp WHERE k >= 7 AND k < 32), c AS (SELECT *, u - avg(u) OVER w AS a, v - avg(v) OVER w AS b FROM l WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, round(sum(a * b) / (sum(a * a) + 1e-8), 6) AS slope FROM c GROUP BY 1")
def spectral_slope(spark, sf):
    return rounded(batched(vectors(spark, sf), lambda x: {"slope": kernels.Batch(x, 64.0).slope(7, 32)}, ["slope"]))


@query("hjorth", f"WITH {Z}, d AS (SELECT vec_id, i, z, z - lag(z) OVER w AS d FROM zs WINDOW w AS (PARTITION BY vec_id ORDER BY i)), e AS (SELECT *, d - lag(d) OVER (PARTITION BY vec_id ORDER BY i) AS dd FROM d), s AS (SELECT vec_id, var_pop(z) + 1e-8 AS v0, var_pop(d) + 1e-8 AS v1, var_pop(dd) + 1e-8 AS v2 FROM e GROUP BY 1) SELECT vec_id, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / (sqrt(v1 / v0) + 1e-8), 6) AS complexity FROM s")
def hjorth(spark, sf):
    def var(c: str):
        mid = arrays.mean(F.col(c))
        return arrays.mean(F.transform(c, lambda v: v * v)) - mid * mid + 1e-8

    rows = standardized(spark, sf).withColumn("d", arrays.diff(F.col("z")))
    rows = rows.withColumn("dd", arrays.diff(F.col("d"))).select("vec_id", var("z").alias("v0"), var("d").alias("v1"), var("dd").alias("v2"))
    mob = F.sqrt(F.col("v1") / F.col("v0"))
    return rounded(rows.select("vec_id", mob.alias("mobility"), (F.sqrt(F.col("v2") / F.col("v1")) / (mob + 1e-8)).alias("complexity")))


@query("amplitude_entropy", f"WITH {VECTORS}, r AS (SELECT vec_id, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM v WINDOW w AS (PARTITION BY vec_id)), h AS (SELECT vec_id, least(31, floor((x - lo) / (hi - lo) * 32)) AS bin, count(*) / (64.0 + 1e-9) AS q FROM r GROUP BY 1, 2) SELECT vec_id, round(-sum(q * ln(q)) / ln(32), 4) AS entropy FROM h GROUP BY 1")
def amplitude_entropy(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        h = np.stack([np.histogram(r, bins=32)[0] for r in x])
        return {"entropy": kernels.entropy(h / (h.sum(1, keepdims=True) + 1e-9), 32)}

    return rounded(batched(vectors(spark, sf), fn, ["entropy"]), 4)


@query("simple_dynamics", f"WITH {VECTORS}, d AS (SELECT vec_id, i, x, x - lag(x) OVER w AS d FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)), e AS (SELECT *, lag(d) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM d) SELECT vec_id, round(sum(abs(d)), 6) AS waveform_length, round(sqrt(avg(d * d)), 6) AS rms_diff, round(avg(CASE WHEN p IS NULL THEN NULL WHEN d * p < 0 THEN 1.0 ELSE 0.0 END), 6) AS slope_changes FROM e GROUP BY 1")
def simple_dynamics(spark, sf):
    rows = vectors(spark, sf).withColumn("d", arrays.diff(F.col("w")))
    turns = F.zip_with(F.slice("d", 2, 62), F.slice("d", 1, 62), lambda a, b: F.when(a * b < 0, 1.0).otherwise(0.0))
    return rounded(rows.select("vec_id", arrays.total(F.transform("d", F.abs)).alias("waveform_length"), F.sqrt(arrays.mean(F.transform("d", lambda v: v * v))).alias("rms_diff"), arrays.mean(turns).alias("slope_changes")))


PPG = DFT + """,
pg AS (SELECT vec_id, sum(CASE WHEN k IN (1, 2) THEN p ELSE 0 END) AS card, sum(CASE WHEN k >= 1 AND k < 8 THEN p ELSE 0 END) AS low, sum(CASE WHEN k >= 8 AND k < 32 THEN p ELSE 0 END) AS high, sum(CASE WHEN k >= 1 AND k < 32 THEN p ELSE 0 END) AS wide FROM sp GROUP BY 1),
pe AS (SELECT sp.vec_id, -sum(p / (low + 1e-8) * ln(p / (low + 1e-8) + 1e-8)) / ln(7) AS e FROM sp JOIN pg ON pg.vec_id = sp.vec_id WHERE k >= 1 AND k < 8 GROUP BY 1),
pl AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.z * b.z) AS r FROM zs a JOIN zs b ON b.vec_id = a.vec_id AND b.i - a.i >= 28 GROUP BY 1, 2),
pr AS (SELECT pl.vec_id, greatest(0, max(r / (e + 1e-8))) AS r FROM pl JOIN (SELECT vec_id, sum(z * z) AS e FROM zs GROUP BY 1) n ON n.vec_id = pl.vec_id GROUP BY 1),
pm AS (SELECT vec_id, avg(z * z * z) AS s, avg(z * z * z * z) - 3 AS q FROM zs GROUP BY 1)"""

HAAR4 = HAAR + """,
h3 AS (SELECT vec_id, k // 2 AS k, sum(a) / sqrt(2) AS a, sum(CASE WHEN k % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d FROM h2 GROUP BY 1, 2),
h4 AS (SELECT vec_id, k // 2 AS k, sum(a) / sqrt(2) AS a, sum(CASE WHEN k % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d FROM h3 GROUP BY 1, 2),
dz AS (SELECT vec_id, z - lag(z) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM zs), ds AS (SELECT vec_id, max(abs(d)) AS m, sqrt(avg(d * d)) AS r FROM dz GROUP BY 1),
""" + ", ".join(f"l{j} AS (SELECT h{j}.vec_id, stddev_pop(d) AS s, max(abs(d)) AS m, sum(d * d) / max(e) AS r, (sum(d * d) + 1e-8) / (sum(a * a) + 1e-8) AS b FROM h{j} JOIN en ON en.vec_id = h{j}.vec_id GROUP BY 1)" for j in (1, 2, 3, 4))

EEG = DFT + """,
eb AS (SELECT vec_id, sum(CASE WHEN k >= 1 AND k < 25 THEN p ELSE 0 END) + 1e-8 AS total, sum(CASE WHEN k = 1 THEN p ELSE 0 END) AS low, sum(CASE WHEN k >= 5 AND k < 25 THEN p ELSE 0 END) AS high, sum(CASE WHEN k >= 8 AND k < 15 THEN p ELSE 0 END) AS gamma, max(CASE WHEN k = 15 THEN p END) / (quantile_cont(p, 0.5) + 1e-8) AS line FROM sp GROUP BY 1),
ef AS (SELECT vec_id, exp(avg(ln(p + 1e-8))) / (avg(p + 1e-8) + 1e-8) AS flat FROM sp WHERE k >= 5 AND k < 25 GROUP BY 1),
es AS (SELECT vec_id, sum(a * b) / (sum(a * a) + 1e-8) AS slope FROM (SELECT vec_id, u - avg(u) OVER w AS a, v - avg(v) OVER w AS b FROM (SELECT vec_id, ln(4 * k + 1e-8) AS u, ln(p + 1e-8) AS v FROM sp WHERE k >= 2 AND k < 12) WINDOW w AS (PARTITION BY vec_id)) GROUP BY 1),
e1 AS (SELECT vec_id, i, z, z - lag(z) OVER w AS d, sign(z) <> sign(lag(z) OVER w) AS c FROM zs WINDOW w AS (PARTITION BY vec_id ORDER BY i)), e2 AS (SELECT *, d - lag(d) OVER (PARTITION BY vec_id ORDER BY i) AS dd FROM e1),
et AS (SELECT vec_id, avg(CASE WHEN c THEN 1.0 WHEN c IS NULL THEN NULL ELSE 0.0 END) AS zcr, avg(z * z * z * z) - 3 AS kurt, max(abs(d)) AS grad, avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1e-3 THEN 1.0 ELSE 0.0 END) AS flatline, sqrt((var_pop(d) + 1e-8) / (var_pop(z) + 1e-8)) AS mob, sqrt((var_pop(dd) + 1e-8) / (var_pop(d) + 1e-8)) AS mob2 FROM e2 GROUP BY 1)"""

PACK_SQL = {
    "ppg": f"WITH {PPG} SELECT pm.vec_id, round(s, 6) AS ppg_skew, round(q, 6) AS ppg_kurt, round(card / (low + 1e-8), 6) AS ppg_cardiac_ratio, round(high / (wide + 1e-8), 6) AS ppg_hf_ratio, round(pe.e, 6) AS ppg_spec_entropy, round(pr.r, 6) AS ppg_pulse_regularity FROM pm JOIN pg ON pg.vec_id = pm.vec_id JOIN pe ON pe.vec_id = pm.vec_id JOIN pr ON pr.vec_id = pm.vec_id",
    "eda": f"WITH {HAAR4} SELECT l1.vec_id, " + ", ".join(f"round(l{j}.s, 6) AS eda_haar{j}_std, round(l{j}.m, 6) AS eda_haar{j}_max, round(l{j}.r, 6) AS eda_haar{j}_eratio" for j in (1, 2, 3, 4)) + ", round(l1.b, 6) AS eda_detail_approx_ratio, round(ds.m, 6) AS eda_dmax, round(ds.r, 6) AS eda_drms FROM l1 JOIN l2 ON l2.vec_id = l1.vec_id JOIN l3 ON l3.vec_id = l1.vec_id JOIN l4 ON l4.vec_id = l1.vec_id JOIN ds ON ds.vec_id = l1.vec_id",
    "eeg": f"WITH {EEG} SELECT eb.vec_id, round(low / total, 6) AS eeg_low_ratio, round(high / total, 6) AS eeg_high_ratio, round(gamma / total, 6) AS eeg_gamma_ratio, round(high / total / (low / total + 1e-8), 6) AS eeg_tilt, round(flat, 6) AS eeg_flatness, round(line, 6) AS eeg_line_index, round(slope, 6) AS eeg_aperiodic_slope, round(zcr, 6) AS eeg_zcr, round(kurt, 6) AS eeg_kurt, round(grad, 6) AS eeg_max_grad, round(flatline, 6) AS eeg_flatline_frac, round(mob, 6) AS eeg_hjorth_mob, round(mob2 / (mob + 1e-8), 6) AS eeg_hjorth_comp FROM eb JOIN ef ON ef.vec_id = eb.vec_id JOIN es ON es.vec_id = eb.vec_id JOIN et ON et.vec_id = eb.vec_id",
}

for _modality, _fs in (("ppg", 64.0), ("eda", 8.0), ("eeg", 256.0), ("advanced", 64.0)):

    @query(f"{_modality}_features", PACK_SQL.get(_modality))
    def _features(spark, sf, modality=_modality, fs=_fs):
        return rounded(batched(vectors(spark, sf), lambda x: kernels.PACKS[modality](kernels.Batch(x, fs)), NAMES[modality]))



@query("universal_sqis", f"WITH {DFT}, u AS (SELECT vec_id, sum(CASE WHEN k > 40 * 64 / 128.0 THEN p ELSE 0 END) / (sum(p) + 1e-12) AS hf, exp(avg(ln(p + 1e-12))) / avg(p + 1e-12) AS flat FROM sp GROUP BY 1), m AS (SELECT vec_id, avg(z * z * z * z) - 3 AS q, avg(z * z * z) AS s FROM zs GROUP BY 1), d AS (SELECT vec_id, z - lag(z) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM zs), f AS (SELECT vec_id, avg(CASE WHEN abs(d) < 1e-3 THEN 1.0 ELSE 0.0 END) AS fl FROM d WHERE d IS NOT NULL GROUP BY 1) SELECT u.vec_id, round(hf, 4) AS hf_ratio, round(flat, 4) AS spectral_flatness, round(q, 3) AS kurtosis, round(s, 3) AS skewness, round(fl, 4) AS flatline_frac FROM u JOIN m ON m.vec_id = u.vec_id JOIN f ON f.vec_id = u.vec_id")
def universal_sqis(spark, sf):
    return batched(vectors(spark, sf), lambda x: kernels.universal_sqis(kernels.Batch(x, 128.0)), ["hf_ratio", "spectral_flatness", "kurtosis", "skewness", "flatline_frac"])


@query("prefilter")
def prefilter(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        found, score = kernels.prefiltered(kernels.Batch(x, 250.0), "ecg")
        return {"prefiltered": found.astype(float), "score": score}

    return rounded(batched(vectors(spark, sf), fn, ["prefiltered", "score"]))


@query("input_sanity", f"WITH {VECTORS}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS y FROM v), p AS (SELECT vec_id, k, pow(sum(y * cos(2 * pi() * k * i / 64)), 2) + pow(sum(y * sin(2 * pi() * k * i / 64)), 2) AS p FROM c, range(0, 33) r(k) GROUP BY 1, 2), s AS (SELECT vec_id, sum(CASE WHEN k >= 28.8 THEN p ELSE 0 END) / (sum(p) + 1e-12) AS nn FROM p GROUP BY 1) SELECT vec_id, round(nn, 6) AS near_nyquist_frac, round(least(1.0, greatest(0.0, (nn - 0.15) / 0.20)), 6) AS dsi FROM s")
def input_sanity(spark, sf):
    return rounded(batched(vectors(spark, sf), lambda x: kernels.regime(kernels.Batch(x, 64.0)), ["near_nyquist_frac", "dsi"]))


@query("beat_voters")
def beat_voters(spark, sf):
    """Detector agreement, template agreement, rhythm and rate of each window."""

    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        rows = [(kernels.detector_agreement(r, 64.0), kernels.template_agreement(r, 64.0), kernels.rhythm(r, 64.0)[1], kernels.rate_usability(r, 64.0, "ppg")[2]) for r in x]
        return dict(zip(("bsqi", "tsqi", "hr_bpm", "pulse_bpm"), np.array(rows).T, strict=True))

    return rounded(batched(vectors(spark, sf), fn, ["bsqi", "tsqi", "hr_bpm", "pulse_bpm"]))


BREAKDOWN = "array<struct<name:string,value:double,bar:double,informational:boolean>>"


@query("sqi_breakdown")
def sqi_breakdown(spark, sf, modality="eeg"):
    """Named quality figures per window and the consensus of those that count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [kernels.breakdown(np.asarray(w, float), 128.0, modality) for w in f["w"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "rows": rows, "consensus": [kernels.consensus(r) for r in rows]})

    found = vectors(spark, sf).select("vec_id", "w").mapInPandas(run, f"vec_id long, rows {BREAKDOWN}, consensus double")
    return rounded(found.select("vec_id", "consensus", F.explode("rows").alias("r")).select("vec_id", "consensus", "r.*"))


for _modality in ("ecg", "ppg", "eda", "other"):
    query(f"sqi_breakdown_{_modality}")(lambda spark, sf, m=_modality: sqi_breakdown(spark, sf, m))


@query("recovery_filter")
def recovery_filter(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        y = kernels.recovered(x, 64.0, "ppg")
        return {"rms_before": np.sqrt((x**2).mean(1)), "rms_after": np.sqrt((y**2).mean(1))}

    return rounded(batched(vectors(spark, sf), fn, ["rms_before", "rms_after"]))


@query("novelty", f"WITH {Z}, s AS (SELECT vec_id, avg(z * z * z) AS a, avg(z * z * z * z) - 3 AS b FROM zs GROUP BY 1), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, corr(a, b) AS r FROM s), y AS (SELECT vec_id, (a - ma) / (sa + 1e-9) AS u, (b - mb) / (sb + 1e-9) AS v, r FROM s, m) SELECT vec_id, round((u * u - 2 * r * u * v + v * v) / (1 - r * r), 4) AS d2, CASE WHEN u * u >= v * v THEN 'skew' ELSE 'excess' END AS top FROM y")
def novelty(spark, sf):
    """Mahalanobis distance of skewness and excess from their own spread, which is one row."""
    z = standardized(spark, sf)
    rows = z.select("vec_id", arrays.mean(F.transform("z", lambda v: v * v * v)).alias("a"), (arrays.mean(F.transform("z", lambda v: v * v * v * v)) - 3).alias("b"))
    card = rows.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b"), F.corr("a", "b")).first()
    u, v, r = (F.col("a") - card[0]) / (card[1] + 1e-9), (F.col("b") - card[2]) / (card[3] + 1e-9), card[4]
    out = rows.select("vec_id", ((u * u - 2 * r * u * v + v * v) / (1 - r * r)).alias("d2"), F.when(u * u >= v * v, "skew").otherwise("excess").alias("top"))
    return rounded(out, 4)


@query("novelty_fraction", f"WITH {Z}, s AS (SELECT vec_id, avg(z * z * z) AS a FROM zs GROUP BY 1), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa FROM s), d AS (SELECT vec_id, pow((a - ma) / (sa + 1e-9), 2) AS d2, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM s, m) SELECT round(avg(CASE WHEN d2 > 2.7 THEN 1.0 ELSE 0.0 END), 6) AS fraction, count(*) AS n FROM d WHERE k % greatest(1, n // 200) = 0")
def novelty_fraction(spark, sf):
    """Share of novel windows among every max(1, n div 200)-th."""
    z = standardized(spark, sf).select("vec_id", arrays.mean(F.transform("z", lambda v: v * v * v)).alias("a"))
    card = z.agg(F.avg("a"), F.stddev_pop("a"), F.count("*")).first()
    step = max(1, card[2] // 200)
    rows = running_sums(z.withColumn("one", F.lit(1)), "vec_id", {"k": "one"}, []).filter(F.col("k") % step == 0)
    d2 = F.pow((F.col("a") - card[0]) / (card[1] + 1e-9), F.lit(2.0))
    return rounded(rows.agg(F.avg((d2 > 2.7).cast("double")).alias("fraction"), F.count("*").alias("n")))


@query("label_outliers", f"WITH {VECTORS}, s AS (SELECT vec_id, label, stddev_pop(x) AS f FROM v GROUP BY 1, 2), m AS (SELECT label, quantile_cont(f, 0.5) AS med, count(*) AS n FROM s GROUP BY 1), d AS (SELECT s.vec_id, s.label, f, med, n, abs(f - med) AS dev FROM s JOIN m ON m.label = s.label), a AS (SELECT label, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1) SELECT vec_id, d.label FROM d JOIN a ON a.label = d.label WHERE NOT (n >= 10 AND dev / (1.4826 * mad + 1e-9) > 3)")
def label_outliers(spark, sf):
    """Windows that are no outliers of their class: robust z of the deviation at most 3, classes of 10 rows and more."""
    w = vectors(spark, sf)
    mid = arrays.mean(F.col("w"))
    rows = w.select("vec_id", "label", F.sqrt(arrays.mean(F.transform("w", lambda v: v * v)) - mid * mid).alias("f"))
    stats = rows.groupBy("label").agg(F.percentile("f", F.lit(0.5)).alias("med"), F.count("*").alias("n"))
    rows = rows.join(stats, "label").withColumn("dev", F.abs(F.col("f") - F.col("med")))
    mads = rows.groupBy("label").agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    rows = rows.join(mads, "label")
    return rows.filter(~((F.col("n") >= 10) & (F.col("dev") / (1.4826 * F.col("mad") + 1e-9) > 3))).select("vec_id", "label")


@query("running_mean", f"WITH {VECTORS} SELECT vec_id, i::INT AS i, round(avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM v")
def running_mean(spark, sf):
    from pyspark.sql import Window as W

    rows = tables.long_windows(vectors(spark, sf))
    return rounded(rows.select("vec_id", "i", F.avg("x").over(W.partitionBy("vec_id").orderBy("i").rowsBetween(-4, 0)).alias("m")))


@query("tkeo", f"WITH {VECTORS}, k AS (SELECT vec_id, x * x - lag(x) OVER w * lead(x) OVER w AS e FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(avg(e), 6) AS mean_energy, round(max(e), 6) AS peak_energy FROM k GROUP BY 1")
def tkeo(spark, sf):
    at = lambda k: F.slice("w", k, 62)
    energy = F.zip_with(F.transform(at(2), lambda v: v * v), F.zip_with(at(1), at(3), lambda a, b: a * b), lambda a, b: a - b)
    return rounded(vectors(spark, sf).select("vec_id", arrays.mean(energy).alias("mean_energy"), F.array_max(energy).alias("peak_energy")))


@query("flatline_per_recording", f"WITH {SAMPLES}, {flat_rows('samples', 8)} SELECT rec, round(avg(CASE WHEN flat THEN 1.0 ELSE 0.0 END), 6) AS flatline_frac FROM flats GROUP BY 1")
def flatline_per_recording(spark, sf):
    return rounded(quality.flatline(samples(spark, sf), 8.0))


@query("quality_matrix", f"WITH {VECTORS}, c AS (SELECT vec_id, i, x, x - avg(x) OVER w AS c, max(x) OVER w AS hi, min(x) OVER w AS lo, abs(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i)) AS d FROM v WINDOW w AS (PARTITION BY vec_id)), g AS (SELECT vec_id, avg(c * c) AS v, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4, avg(CASE WHEN d < 1e-4 THEN 1.0 WHEN d IS NULL THEN NULL ELSE 0.0 END) AS flatline, avg(CASE WHEN hi - x < 0.01 * (hi - lo + 1e-9) OR x - lo < 0.01 * (hi - lo + 1e-9) THEN 1.0 ELSE 0.0 END) AS saturation FROM c GROUP BY 1) SELECT vec_id, round(m4 / (v * v) - 3, 6) AS kurtosis, round(m3 / pow(v, 1.5), 6) AS skewness, round(flatline, 6) AS flatline, round(saturation, 6) AS saturation FROM g")
def quality_matrix(spark, sf):
    return rounded(batched(vectors(spark, sf), lambda x: research.quality_matrix(x, 64.0, "ppg"), ["kurtosis", "skewness", "flatline", "saturation"]))


@query("nonlinear_features")
def nonlinear_features(spark, sf):
    names = list(research.nonlinear(np.random.default_rng(0).normal(size=(1, 64)), 64.0))
    return rounded(batched(vectors(spark, sf), lambda x: research.nonlinear(x, 64.0), names))


@query("poincare", f"WITH {Z}, d AS (SELECT vec_id, i, z - lag(z) OVER w AS d FROM zs WINDOW w AS (PARTITION BY vec_id ORDER BY i)), p AS (SELECT vec_id, d AS b, lag(d) OVER (PARTITION BY vec_id ORDER BY i) AS a FROM d) SELECT vec_id, round(stddev_pop((b - a) / sqrt(2)), 6) AS sd1, round(stddev_pop((b + a) / sqrt(2)), 6) AS sd2 FROM p WHERE a IS NOT NULL GROUP BY 1")
def poincare(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        found = research.nonlinear(x, 64.0)
        return {"sd1": found["poincare_sd1"], "sd2": found["poincare_sd2"]}

    return rounded(batched(vectors(spark, sf), fn, ["sd1", "sd2"]))


@query("derived_channels")
def derived_channels(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        return {f"{k}_{s}": getattr(v, s)(1) for k, v in research.channels(x, 64.0).items() for s in ("mean", "max")}

    return rounded(batched(vectors(spark, sf), fn, [f"{k}_{s}" for k in ("raw", "stalta", "trend", "peak", "tkeo") for s in ("mean", "max")]))


@query("spectral_figures")
def spectral_figures(spark, sf):
    names = [n for n in research.spectral_figures(np.zeros((1, 64)), 128.0, "eeg")]
    out = batched(vectors(spark, sf), lambda x: {f"f{k}": v for k, v in enumerate(research.spectral_figures(x, 128.0, "eeg").values())}, [f"f{k}" for k in range(len(names))])
    return rounded(out.select("vec_id", *(F.col(f"f{k}").alias(n.replace("-", "_").replace(".", "p")) for k, n in enumerate(names))))


@query("band_usability")
def band_usability(spark, sf):
    return usable_parts(vectors(spark, sf), 16.0, "eeg", "band string, lo_hz double, hi_hz double, usable boolean, snr_db double, verdict string")


@query("component_usability")
def component_usability(spark, sf):
    raised = vectors(spark, sf).withColumn("w", F.transform("w", lambda v: v + 2))
    return usable_parts(raised, 8.0, "eda", "component string, usable boolean, value double, verdict string")


def usable_parts(windows: DataFrame, fs: float, modality: str, schema: str) -> DataFrame:
    """A row per window and band or component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                found = usability.usability(np.stack(f["w"].to_list()).astype(float), fs, modality)
                yield pd.DataFrame([{"vec_id": i, **r} for i, rows in zip(f["vec_id"], found, strict=True) for r in rows])

    return rounded(windows.select("vec_id", "w").mapInPandas(run, f"vec_id long, {schema}"))


@query("integrity_guard")
def integrity_guard(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "w", F.when(F.col("label") < 5, 0.2).otherwise(0.8).alias("p_unusable"))
    return rounded(explain.integrity_guard(rows, 64.0, "ecg", "vec_id").drop("w"))


@query("rate_usability")
def rate_usability(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "w", F.concat(F.lit("Q"), (F.col("label") % 4).cast("string")).alias("tier"))
    return rounded(explain.rate_usability(rows, 16.0, "ppg", "vec_id").drop("w"))


def deviation_grade(x: np.ndarray) -> np.ndarray:
    """A grader for explanations: worse the more a window deviates."""
    s = np.clip(x.std(1) * 4, 0, 1)
    return np.stack([s * 0.6, s * 0.4, (1 - s) * 0.4, (1 - s) * 0.6], 1)


@query("saliency")
def saliency(spark, sf):
    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        maps = np.stack([explain.saliency(r, deviation_grade, 16.0) for r in x])
        return {"peak": maps.max(1), "at": maps.argmax(1) / 16.0, "spread": (maps > 0.5 * maps.max(1, keepdims=True)).mean(1)}

    return rounded(batched(vectors(spark, sf), fn, ["peak", "at", "spread"]))


@query("group_attribution")
def group_attribution(spark, sf):
    """Shapley values of two groups of features for a logistic grade of the EEG pack."""
    groups = [list(range(6)), list(range(6, 13))]

    def fn(x: np.ndarray) -> dict[str, np.ndarray]:
        have = np.stack(list(kernels.eeg_pack(kernels.Batch(x, 64.0)).values()), 1)
        value = lambda f: 1 / (1 + np.exp(-f.mean(1)))
        phi = np.stack([explain.group_shapley(value, h, np.zeros(have.shape[1]), groups) for h in have])
        return {"spectral": phi[:, 0], "temporal": phi[:, 1]}

    return rounded(batched(vectors(spark, sf), fn, ["spectral", "temporal"]))


@query("narratives")
def narratives(spark, sf):
    rows = saliency(spark, sf).withColumn("lead", F.lit("Spectral")).withColumn("phi", F.col("peak") - 0.4).withColumn("tags", F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("motion"))).otherwise(F.array().cast("array<string>")))
    text = explain.narrative(F.lit("Q1"), F.lit("Poor"), F.lit(4.0), F.col("at"), F.col("spread"), F.col("peak"), F.col("lead"), F.col("phi"), F.col("tags"))
    return rows.select("vec_id", text.alias("narrative"))
