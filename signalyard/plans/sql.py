"""Common table expressions of the SQL twins: samples, windows, grades and intervals."""
from __future__ import annotations

LENGTH, STEP = 32, 16

SAMPLES = """samples AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events),
lens AS (SELECT rec, count(*) AS len FROM samples GROUP BY rec)"""

FLAWED = SAMPLES + """,
flawed AS (SELECT rec, n, CASE WHEN n % 17 = 3 THEN NULL WHEN n >= 20 AND n < 26 THEN 0.0 ELSE least(x, 150.0) END AS x FROM samples)"""

STARTS = SAMPLES + f""",
starts AS (SELECT rec, unnest(range(0, len - {LENGTH} + 1, {STEP})) AS start_n FROM lens WHERE len >= {LENGTH}
  UNION SELECT rec, len - {LENGTH} FROM lens WHERE len >= {LENGTH})"""

STATS = STARTS + f""",
stats AS (SELECT t.rec, t.start_n, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM starts t
  JOIN samples s ON s.rec = t.rec AND s.n >= t.start_n AND s.n < t.start_n + {LENGTH} GROUP BY 1, 2)"""

GRADES = STATS + """,
e0 AS (SELECT *, sd / (abs(m) + 1e-9) AS cv FROM stats),
e1 AS (SELECT *, exp(-pow((cv - 1.15) / 0.15, 2)) AS a0, exp(-pow((cv - 1.02) / 0.15, 2)) AS a1, exp(-pow((cv - 0.92) / 0.15, 2)) AS a2, exp(-pow((cv - 0.80) / 0.15, 2)) AS a3 FROM e0),
e2 AS (SELECT *, 1e-12 + a0 + a1 + a2 + a3 AS t FROM e1),
e3 AS (SELECT rec, start_n, m, sd, lo, hi, a0 / t AS p0, a1 / t AS p1, a2 / t AS p2, a3 / t AS p3 FROM e2),
grades AS (SELECT *, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 'Q0' WHEN p1 THEN 'Q1' WHEN p2 THEN 'Q2' ELSE 'Q3' END AS tier, greatest(p0, p1, p2, p3) AS confidence,
  -(greatest(p0, 1e-12) * ln(greatest(p0, 1e-12)) + greatest(p1, 1e-12) * ln(greatest(p1, 1e-12)) + greatest(p2, 1e-12) * ln(greatest(p2, 1e-12)) + greatest(p3, 1e-12) * ln(greatest(p3, 1e-12))) / ln(4) AS uncertainty FROM e3)"""

RUNS = GRADES + """,
marks AS (SELECT *, CASE WHEN lag(tier) OVER w = tier THEN 0 ELSE 1 END AS new FROM grades WINDOW w AS (PARTITION BY rec ORDER BY start_n)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY rec ORDER BY start_n) - 1 AS BIGINT) AS run FROM marks),
runs AS (SELECT rec, run, min(start_n) AS f, max(start_n) AS l, min(tier) AS tier, avg(confidence) AS confidence, avg(uncertainty) AS uncertainty, count(*) AS n_windows FROM numbered GROUP BY 1, 2)"""

INTERVALS = RUNS + f""",
edges AS (SELECT *, lag(l) OVER w + {LENGTH} AS before, lead(f) OVER w AS after FROM runs WINDOW w AS (PARTITION BY rec ORDER BY run)),
intervals AS (SELECT rec, run, tier, confidence, uncertainty, n_windows,
  CASE WHEN before IS NULL OR f >= before THEN CAST(f AS DOUBLE) ELSE (f + before) / 2.0 END AS start_sec,
  CASE WHEN after IS NULL OR after >= l + {LENGTH} THEN CAST(l + {LENGTH} AS DOUBLE) ELSE (after + l + {LENGTH}) / 2.0 END AS end_sec FROM edges)"""

TAGGED = INTERVALS + """,
tags AS (SELECT rec, run, start_n, list_filter([CASE WHEN hi - lo > 200 THEN 'motion' END, CASE WHEN hi >= 150 THEN 'rail' END, CASE WHEN sd < 42 THEN 'still' END], lambda x: x IS NOT NULL) AS artifacts FROM numbered)"""

VECTORS = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"

Z = VECTORS + """,
zs AS (SELECT vec_id, label, i, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8) AS z FROM v WINDOW w AS (PARTITION BY vec_id))"""

#: Labels as binary truth, with a score that follows the length of the text.
BINARY = "b AS (SELECT l.doc_id, l.quality AS y, round(1.0 - exp(-d.n_chars / 2000.0), 3) AS score, d.source AS cluster, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"

#: Grades of documents: truth from the labels and the length, prediction from the length alone.
GRADED = "g AS (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 2 ELSE 0 END + CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS y, CAST(least(3, d.n_chars // 1000) AS INT) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def rolling(name: str, table: str, column: str, width: int) -> str:
    """A deviation over `width` samples around each, each window by itself."""
    lo = f"greatest(i.n - least({width}, i.len) // 2, 0)"
    return f"{name} AS (SELECT i.rec, i.n, stddev_pop(j.{column}) AS s FROM {table} i JOIN {table} j ON j.rec = i.rec AND j.n >= {lo} AND j.n < least({lo} + least({width}, i.len), i.len) GROUP BY 1, 2)"


def flat_rows(source: str, fs: int) -> str:
    """Table `flats` (rec, n, flat) from samples in `source`, as operators/quality.py has the rules."""
    width, beat = max(round(0.5 * fs), 64), max(2, round(2 * fs))
    return f"""fv AS (SELECT rec, n, x AS v, count(*) OVER (PARTITION BY rec) AS len, last_value(x IGNORE NULLS) OVER (PARTITION BY rec ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
fs AS (SELECT rec, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS span, count(v) AS valid, stddev_pop(v) AS sd, stddev_pop(v - before) AS jitter FROM fv GROUP BY 1),
fy AS (SELECT a.rec, a.n, a.len, coalesce(a.v, 0) - s.med AS y FROM fv a JOIN fs s ON s.rec = a.rec),
fd AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY rec ORDER BY n), 0) AS d FROM fy),
{rolling("fa", "fd", "y", width)}, {rolling("fx", "fd", "y", beat)}, {rolling("fw", "fd", "d", beat)},
fc AS (SELECT rec, quantile_cont(s, 0.95) AS alive, avg(s) AS act, stddev_pop(s) AS act_sd FROM fa GROUP BY 1),
fq AS (SELECT a.rec, a.n, d.len, s.span <= 0 OR s.valid = 0 OR (s.valid >= 3 AND (s.sd <= 0 OR (s.jitter >= 1.38 * s.sd AND c.act > 0 AND c.act_sd / c.act < 0.3))) AS dead,
  a.s <= 1e-3 * s.span OR (c.alive > 0 AND a.s <= 0.15 * c.alive AND a.s <= 0.15 * s.span AND CASE WHEN x.s > 0 THEN w.s / x.s ELSE 0 END >= 1.3) AS still
  FROM fa a JOIN fd d ON d.rec = a.rec AND d.n = a.n JOIN fx x ON x.rec = a.rec AND x.n = a.n JOIN fw w ON w.rec = a.rec AND w.n = a.n JOIN fs s ON s.rec = a.rec JOIN fc c ON c.rec = a.rec),
fr AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY n) AS run FROM (SELECT *, CASE WHEN lag(still) OVER (PARTITION BY rec ORDER BY n) = still THEN 0 ELSE 1 END AS nw FROM fq)),
flats AS (SELECT rec, n, dead OR (still AND count(*) OVER (PARTITION BY rec, run) >= least({max(width, fs)}, len)) AS flat FROM fr)"""
