"""Windows, runs and refinement on generated recordings."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalyard.operators import labelled, refine, segments, windows


def samples(spark, records):
    return spark.createDataFrame([(r, n, float(v)) for r, x in enumerate(records) for n, v in enumerate(x)], "rec long, n long, x double")


@pytest.mark.parametrize("overlap", [0, 0.25, 0.5, 0.75, 0.9])
def test_windows_cover_the_tail(spark, overlap):
    length = 20
    step = windows.step_of(length, overlap)
    data = samples(spark, [np.arange(n) for n in (20, 61, 40, 19, 75)])
    starts = {r: set() for r in range(5)}
    for r in windows.window_starts(data, length, step).collect():
        starts[r["rec"]].add(r["start_n"])
    for rec, n in enumerate((20, 61, 40, 19, 75)):
        want = {*range(0, n - length + 1, step), n - length} if n >= length else set()
        assert starts[rec] == want
    dealt = windows.windowed(data, length, step).groupBy("rec", "start_n").agg(F.count("*").alias("k"), F.min("x").alias("lo")).collect()
    assert {(r["rec"], r["start_n"]) for r in dealt} == {(r, s) for r, own in starts.items() for s in own}
    assert all(r["k"] == length and r["lo"] == r["start_n"] for r in dealt)


def test_steps_round_to_even_and_overlap_is_checked():
    assert windows.step_of(5, 0.5) == 2 and windows.step_of(3, 0.5) == 2 and windows.step_of(1, 0.9) == 1
    with pytest.raises(ValueError):
        windows.step_of(10, 1.0)


def test_short_recordings_are_reported(spark):
    assert [tuple(r) for r in windows.not_analysed(samples(spark, [range(5), range(9)]), 8).collect()] == [(0, 5, 8)]


def graded(spark, tiers, starts=None):
    starts = starts or [10 * i for i in range(len(tiers))]
    rows = [(0, s, t, 0.5 + 0.1 * i, 0.0) for i, (s, t) in enumerate(zip(starts, tiers, strict=True))]
    return spark.createDataFrame(rows, "rec long, start_n long, tier string, confidence double, uncertainty double")


def runs(spark, tiers, length, starts=None):
    rows = segments.run_length_encode(graded(spark, tiers, starts), length).orderBy("run").collect()
    return [(r["start_sec"], r["end_sec"], r["tier"]) for r in rows]


def test_runs_meet_in_the_middle(spark):
    assert runs(spark, ["Q3", "Q3", "Q1", "Q1", "Q1", "Q3"], 20) == [(0, 25, "Q3"), (25, 55, "Q1"), (55, 70, "Q3")]
    assert runs(spark, ["Q3", "Q1"], 10) == [(0, 10, "Q3"), (10, 20, "Q1")]
    assert runs(spark, ["Q3", "Q1"], 10, [0, 15]) == [(0, 10, "Q3"), (15, 25, "Q1")]
    assert runs(spark, ["Q3", "Q3", "Q1"], 10, [0, 10, 13]) == [(0, 16.5, "Q3"), (16.5, 23, "Q1")]


def test_intervals_are_contiguous(spark):
    rng = np.random.default_rng(0)
    tiers = [f"Q{k}" for k in rng.integers(0, 4, 60)]
    got = runs(spark, tiers, 25)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(got, got[1:], strict=False))
    assert got[0][0] == 0 and got[-1][1] == 590 + 25


def test_unknown_roles_are_refused(spark):
    with pytest.raises(ValueError):
        segments.filter_intervals(segments.run_length_encode(graded(spark, ["Q3"]), 10), "nice")


@pytest.mark.parametrize(("total", "burst"), [(600, (140, 150)), (612, (180, 190))])
def test_refinement_never_shows_better_than_a_covering_window(spark, total, burst):
    x = 0.1 * np.sin(2 * np.pi * 0.11 * np.arange(total))
    x[slice(*burst)] = 3 * np.abs(np.random.default_rng(0).normal(size=burst[1] - burst[0])) + 1.5
    data = samples(spark, [x])
    wins = windows.stub_grades(windows.window_stats(data, 100, 50)).cache()
    shown = segments.run_length_encode(wins, 100)
    fine = sorted((r["start_sec"], r["end_sec"], r["tier"], r["model_tier"]) for r in refine.refine(shown, wins, data, 100, 10).collect())
    before = sorted((r["start_sec"], r["end_sec"], r["tier"]) for r in shown.collect())
    assert fine[0][0] == 0 and fine[-1][1] == total and all(a[1] == b[0] for a, b in zip(fine, fine[1:], strict=False))
    poor = lambda rows: sum(r[1] - r[0] for r in rows if r[2] in segments.POOR)
    assert poor(fine) <= poor(before)
    tiers = [(r["start_n"], r["tier"]) for r in wins.collect()]
    for s, e, tier, _ in fine:
        for lo in np.arange(s, e, 10):
            hi = min(lo + 10, e)
            best = max((t for at, t in tiers if at <= lo and at + 100 >= hi), default="Q0")
            assert tier <= best
    core = [r for r in fine if r[0] < burst[1] and r[1] > burst[0]]
    assert all(r[2] == "Q0" for r in core)


def test_overlap_join_counts_each_pair_once(spark):
    rng = np.random.default_rng(1)
    iv = [(int(r), float(s), float(s + d)) for r, s, d in zip(rng.integers(0, 3, 80), rng.integers(0, 100, 80), rng.integers(1, 30, 80), strict=True)]
    sp = [(int(r), float(s), float(s + d)) for r, s, d in zip(rng.integers(0, 3, 60), rng.integers(0, 100, 60), rng.integers(1, 30, 60), strict=True)]
    a, b = spark.createDataFrame(iv, "rec long, start_sec double, end_sec double"), spark.createDataFrame(sp, "rec long, lo double, hi double")
    want = sorted((r, s, e, lo, hi) for r, s, e in iv for q, lo, hi in sp if r == q and s < hi and e > lo)
    assert sorted(map(tuple, segments.overlap_join(a, b, 7.0).select("rec", "start_sec", "end_sec", "lo", "hi").collect())) == want


def test_one_shuffle_feeds_windows_and_runs(spark, sf):
    from signalyard.plans import views

    plan = views.intervals(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_window_grades_by_extent_and_no_worse_than_the_worst(spark):
    noise = np.arange(20) % 7
    data = samples(spark, [noise, noise, noise, noise, np.ones(20), noise])
    spans = [(0, 0, 0, 20, "Q1", "k"), (1, 0, 0, 20, "Q2", "k"), (2, 0, 0, 20, "Q3", "k"), (2, 1, 0, 6, "Q0", "k"), (3, 0, 0, 20, "Q0", "k"), (4, 0, 0, 20, "Q3", "k"), (5, 0, 0, 9, "Q3", "k")]
    rows = labelled.window_grades(data, spark.createDataFrame(spans, "rec long, ord int, s int, e int, label string, kind string"), 20, 20, 0.5).collect()
    assert {r["rec"]: (r["by_fraction"], r["by_burden"], r["flat"]) for r in rows} == {0: (0, 1, False), 1: (0, 2, False), 2: (2, 2, False), 3: (0, 0, False), 4: (0, 0, True)}
