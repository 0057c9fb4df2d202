"""Array kernels, quality, metrics of small cases."""
from __future__ import annotations

import math

import numpy as np
import pytest

from signalyard.evaluation import metrics, statistics
from signalyard.functions import kernels
from signalyard.operators import pyramid, quality
from signalyard.sources import formats


def wave(hz, fs, seconds, noise=0.0, seed=0):
    t = np.arange(int(fs * seconds)) / fs
    return np.sin(2 * np.pi * hz * t) + noise * np.random.default_rng(seed).normal(size=len(t))


def beats(fs=250, seconds=20, rate=1.1):
    t = np.arange(fs * seconds) / fs
    return sum(np.exp(-(((t - k / rate) / 0.02) ** 2)) for k in range(1, int(seconds * rate))) + 0.01 * np.random.default_rng(0).normal(size=len(t))


def test_spectra_find_their_band():
    b = kernels.Batch(np.stack([wave(1.5, 64, 10), wave(20, 64, 10)]), 64)
    ratio = kernels.ppg_pack(b)["ppg_cardiac_ratio"]
    assert ratio[0] > 0.9 and ratio[1] < 0.1


def test_packs_do_not_depend_on_scale():
    x = np.stack([wave(1.3, 64, 10, 0.3, s) for s in range(3)])
    for name, pack in kernels.PACKS.items():
        a, b = pack(kernels.Batch(x, 64)), pack(kernels.Batch(1000 * x + 7, 64))
        for k in a:
            assert np.allclose(a[k], b[k], rtol=1e-4, atol=1e-5), (name, k)


def test_packs_survive_missing_and_constant_windows():
    x = np.stack([np.full(640, np.nan), np.zeros(640), np.r_[np.inf, wave(1, 64, 10)[1:]]])
    for pack in kernels.PACKS.values():
        assert all(np.isfinite(v).all() for v in pack(kernels.Batch(x, 64)).values())


def test_recurrence_and_symbols_tell_rhythm_from_noise():
    b = kernels.Batch(np.stack([wave(1, 64, 8), np.random.default_rng(1).normal(size=512)]), 64)
    assert b.recurrence()["rqa_det"][0] > b.recurrence()["rqa_det"][1]
    assert b.dispersion_entropy()[0] < b.dispersion_entropy()[1]
    assert b.jumps()["jump_ratio"].min() >= 0


def test_beats_and_voters():
    x = beats()
    assert kernels.heart_rate(x, 250) == pytest.approx(66, abs=2)
    assert kernels.detector_agreement(x, 250) > 0.9 and kernels.template_agreement(x, 250) > 0.9
    assert kernels.rhythm(x, 250)[0]
    noise = np.random.default_rng(2).normal(size=5000)
    assert kernels.detector_agreement(noise, 250) < 0.9 and kernels.template_agreement(noise, 250) < 0.7
    assert kernels.pulse_rate(wave(1.2, 64, 20), 64) == pytest.approx(72, abs=2)
    assert kernels.rate_usability(x, 250, "ecg")[0] and not kernels.rate_usability(x, 250, "eda")[0]


def test_peaks_keep_the_highest_of_neighbours():
    x = np.zeros(40)
    x[[5, 8, 20]] = [1, 3, 2]
    assert kernels.peaks(x, 0.5, 5).tolist() == [8, 20] and kernels.peaks(x, 0.5, 3).tolist() == [5, 8, 20]


def test_filters_and_prefiltering():
    x = wave(2, 250, 10) + wave(90, 250, 10)
    y = kernels.brick_wall(x, 250, 0.5, 40)
    assert np.allclose(y, wave(2, 250, 10), atol=0.02)
    noisy = wave(8, 250, 10, 0.5)
    found, _ = kernels.prefiltered(kernels.Batch(np.stack([noisy, kernels.brick_wall(noisy, 250, 0.5, 40)]), 250), "ecg")
    assert found.tolist() == [False, True]
    assert kernels.regime(kernels.Batch(np.stack([wave(31, 64, 10), wave(1, 64, 10)]), 64))["dsi"].tolist() == [1.0, 0.0]


def test_breakdown_rows_and_consensus():
    for modality, n in (("ecg", 8), ("ppg", 6), ("eeg", 6), ("eda", 2), ("other", 1)):
        rows = kernels.breakdown(wave(1.1, 128, 10, 0.1), 128, modality)
        assert len(rows) == n and all(0 <= r["bar"] <= 1 for r in rows) and 0 <= kernels.consensus(rows) <= 1
    assert kernels.breakdown(np.zeros(4), 128, "ecg") == [] and kernels.consensus([]) == -1.0


def test_flat_stretches(spark):
    rng = np.random.default_rng(3)
    live = wave(1, 250, 20, 0.05)
    half, coloured = live.copy(), live.copy()
    half[2500:] = 0.001 * rng.normal(size=2500)
    coloured[2500:] = 0.01 * np.convolve(rng.normal(size=2520), np.ones(3) / 3, "valid")[:2500]
    cases = {"live": live, "half": half, "tiny": 1e-6 * half, "coloured": coloured, "zeros": np.zeros(500), "missing": np.full(500, np.nan), "noise": rng.normal(size=5000), "short": wave(1, 250, 0.2)}
    rows = [(k, i, float(v)) for k, x in cases.items() for i, v in enumerate(x)]
    got = {r["rec"]: r["flatline_frac"] for r in quality.flatline(spark.createDataFrame(rows, "rec string, n long, x double"), 250.0).collect()}
    assert got["live"] == 0 and 0.4 < got["half"] < 0.6 and got["tiny"] == got["half"]
    assert got["zeros"] == got["missing"] == got["noise"] == 1 and got["short"] == 0
    assert got["coloured"] < 0.05  # noise with some structure is no dead stretch


def test_rolling_deviation_keeps_its_width_at_the_left(spark):
    rng = np.random.default_rng(4)
    cases = {n: rng.normal(size=n) for n in (1, 3, 8, 9, 10, 50)}
    rows = spark.createDataFrame([(k, i, float(v), k) for k, y in cases.items() for i, v in enumerate(y)], "rec int, n long, y double, len long")
    for width in (2, 9):
        for r in quality.rolling_std(rows, "y", width, "sd").collect():
            w = min(width, r["rec"])
            lo = max(0, r["n"] - w // 2)
            assert r["sd"] == pytest.approx(cases[r["rec"]][lo : lo + w].std(), abs=1e-7)


@pytest.mark.parametrize(("a", "b", "want"), [(500, 250, (1, 2)), (360, 250, (25, 36)), (250, 250, (1, 1)), (64, 8, (1, 8)), (44100, 256, (4, 689)), (30000, 256, (16, 1875)), (10000, 8, (1, 1250)), (700, 64, (16, 175))])
def test_resample_ratios(a, b, want):
    assert formats.resample_ratio(a, b) == want


def test_resampling_keeps_a_slow_wave():
    y = formats.resample(wave(1, 100, 10), 64, 100)
    assert len(y) == 640 and np.abs(y[64:-64] - wave(1, 64, 10)[64:-64]).max() < 0.01


def test_levels_and_buckets():
    assert [pyramid.select_level(x) for x in (0.3, 1, 8, 63, 64, 9000)] == [1, 1, 8, 8, 64, 4096]
    assert pyramid.samples_per_bucket(100, 10) == 20 and pyramid.samples_per_bucket(1, 10) == 2


def test_single_class_is_undefined(spark):
    rows = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, score double")
    assert metrics.auroc(rows).first()["auroc"] is None and metrics.average_precision(rows).first()["ap"] is None


def test_intervals_of_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v + m), k) for k, m in enumerate(rng.normal(size=12)) for v in rng.normal(size=20)]
    df = spark.createDataFrame(rows, "v double, c int")
    for method in ("t", "percentile", "bca"):
        r = statistics.cluster_interval(df, "v", "c", method, n_boot=300).first()
        assert r["lo"] < r["mean"] < r["hi"] and r["n_clusters"] == 12
    assert statistics.t_quantile(0.975, 11) == pytest.approx(2.200985, abs=1e-3) and statistics.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    assert statistics.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=0.02) and math.isclose(statistics.t_quantile(0.975, 2), 4.302653, rel_tol=1e-5)


def test_phrases_of_known_strings():
    from signalyard.functions import research

    assert research.phrases(b"0001101001000101") == 6 and research.phrases(b"0" * 50) == 2 and research.phrases(b"") == 0


def test_research_banks_tell_noise_from_rhythm():
    from signalyard.functions import research

    x = np.stack([wave(1, 64, 10), np.random.default_rng(0).normal(size=640)])
    f = research.nonlinear(x, 64)
    assert all(np.isfinite(v).all() for v in f.values()) and len(f) == 18
    assert f["sample_entropy"][0] < f["sample_entropy"][1] and f["higuchi_fd"][0] < 1.2 < 1.8 < f["higuchi_fd"][1]
    assert f["lziv"][0] < f["lziv"][1] and f["dfa_alpha"][1] == pytest.approx(0.5, abs=0.15)
    s = research.spectral_figures(x, 64, "ppg")
    assert s["dom_freq"][0] == pytest.approx(1, abs=0.1) and s["spec_entropy"][0] < s["spec_entropy"][1]
    assert all(np.isfinite(v).all() for v in research.channels(x, 64.0).values())
    for kind in ("burst", "clip", "dropout", "motion", "powerline"):
        assert not np.allclose(research.inject(x[0], kind), x[0])


def test_usability_rows():
    from signalyard.functions import usability

    rng = np.random.default_rng(1)
    drift = np.cumsum(rng.normal(size=2560))
    x = np.stack([drift + 40 * wave(10, 256, 10), np.zeros(2560), drift + 60 * wave(50, 256, 10), rng.normal(size=2560)])
    alpha, dead, mains, noise = ({r["band"]: r for r in rows} for rows in usability.eeg_bands(x, 256))
    assert alpha["alpha"]["verdict"] == "clear" and max(alpha.values(), key=lambda r: r["snr_db"])["band"] == "alpha"
    assert {r["verdict"] for r in dead.values()} == {"flat"} and mains["gamma"]["verdict"] == "mains"
    assert noise["beta"]["verdict"] == "muscle" and noise["delta"]["verdict"] == "no structure"
    assert {r["band"]: r["verdict"] for r in usability.eeg_bands(x[:1, :256], 16)[0]}["beta"] == "above nyquist"
    t = np.arange(480) / 8
    eda = np.stack([5 + 0.3 * np.sin(2 * np.pi * 0.1 * t), np.full(480, 5.0), 100 + np.sin(t), 5 + 4 * t + np.sin(t), 5 + rng.normal(size=480)])
    got = [[r["verdict"] for r in rows] for rows in usability.eda_components(eda, 8)]
    assert got[0][0] == "stable" and got[0][1] in ("responses", "quiet") and got[1] == ["flat", "no baseline"]
    assert got[2][0] == "level" and got[3][0] in ("drift", "level") and got[4] == ["stable", "motion"]
    assert usability.eda_components(eda[:, :3], 8)[0][0]["verdict"] == "too short" and usability.usability(eda, 8, "ppg") == [[]] * 5


def test_vectorised_banks_against_plain_loops():
    from math import factorial

    from signalyard.functions import research

    z = np.random.default_rng(5).normal(size=(3, 90))
    z[1] = np.round(z[1], 1)  # ties
    for order in (3, 5):
        want = []
        for row in z:
            seen = [tuple(np.argsort(row[i : i + order], kind="stable")) for i in range(91 - order)]
            p = np.array([seen.count(s) for s in set(seen)]) / len(seen)
            want.append(-(p * np.log(p)).sum() / np.log(factorial(order)))
        assert research.permutation_entropy(z, order) == pytest.approx(want)
    want = []
    for row in z:
        s = (row - row.mean()) / (row.std() + 1e-8)
        pairs = [sum(max(abs(s[i + k] - s[j + k]) for k in range(m)) <= 0.2 for i in range(91 - m) for j in range(91 - m) if i != j) for m in (2, 3)]
        want.append(-np.log((pairs[1] + 1e-8) / (pairs[0] + 1e-8)))
    assert research.sample_entropy(z) == pytest.approx(want)
    for row, got in zip(z, research.higuchi(z, 4), strict=True):
        curve = [np.mean([np.abs(np.diff(row[m::k])).sum() * 89 / (((89 - m) // k) * k * k) for m in range(k)]) for k in range(1, 5)]
        assert got == pytest.approx(np.polyfit(-np.log(np.arange(1, 5)), np.log(curve), 1)[0], abs=1e-6)


def test_saliency_and_shapley():
    from signalyard.operators import explain

    x = 0.1 * np.sin(np.arange(300))
    x[140:160] += 3
    grade = lambda w: np.stack([s := np.clip(w.std(1), 0, 1), 0 * s, 0 * s, 1 - s], 1)
    found = explain.saliency(x, grade, 10.0)
    assert 120 <= found.argmax() <= 180 and found[:60].max() < found.max()
    value = lambda f: f[:, 0] * f[:, 1] + 2 * f[:, 2]
    phi = explain.group_shapley(value, np.array([1.0, 1.0, 1.0]), np.zeros(3), [[0], [1], [2]])
    assert phi == pytest.approx([0.5, 0.5, 2.0])


@pytest.mark.parametrize("method", ["percentile", "bca"])
def test_interval_queries_draw_2000_replicates(spark, sf, monkeypatch, method):
    import __spark_entry__

    drawn, real = [], statistics.replicates
    monkeypatch.setattr(statistics, "replicates", lambda rows, value, cluster, n, seed: drawn.append(n) or real(rows, value, cluster, n, seed))
    row = __spark_entry__.queries()[f"cluster_interval_{method}"](spark, sf).first()
    assert drawn == [2000] and row["lo"] <= row["mean"] <= row["hi"]
