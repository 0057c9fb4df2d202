"""Guards and explanations of grades.

Array functions get whole batches with all their columns and pick the rows that need work, so nothing is joined back.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .segments import POOR

BSQI_LEAST, TSQI_LEAST = 0.72, 0.66


def integrity_guard(windows: DataFrame, fs: float, modality: str = "ecg", key: str = "window_id") -> DataFrame:
    """`windows` (key, w, p_unusable) with prefiltered, score and override: a window that the grader finds clean, that
    looks filtered, and on which a voter dissents. Voters run on filtered windows only."""

    def dissents(x: np.ndarray) -> bool:
        t = kernels.template_agreement(x, fs, modality)
        return bool((modality == "ecg" and kernels.detector_agreement(x, fs) < BSQI_LEAST) or 0 < t < TSQI_LEAST or not kernels.rhythm(x, fs, modality)[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["w"].to_list()).astype(float)
                found, score = kernels.prefiltered(kernels.Batch(x, fs), modality)
                asked = found & (f["p_unusable"].to_numpy(float) < 0.5)
                yield f.assign(prefiltered=found, score=score, override=[bool(a) and dissents(r) for a, r in zip(asked, x, strict=True)])

    return windows.mapInPandas(run, _with(windows, "prefiltered boolean, score double, override boolean"))


def _with(frame: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", " + more


def rate_usability(windows: DataFrame, fs: float, modality: str, key: str = "window_id") -> DataFrame:
    """`windows` (key, w, tier) with rate_usable and hr_bpm, which are looked for in poor windows only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [kernels.rate_usability(np.asarray(w, float), fs, modality) if t in POOR else (False, 0.0, 0.0) for w, t in zip(f["w"], f["tier"], strict=True)]
            yield f.assign(rate_usable=[bool(r[0]) for r in rows], hr_bpm=[float(r[2]) for r in rows])

    return windows.mapInPandas(run, _with(windows, "rate_usable boolean, hr_bpm double"))


def guard_banner(guards: DataFrame, key: str = "rec") -> DataFrame:
    """(key, warning, banner) from rows (key, ord, fired, reason): whether any guard fired, and the reasons in order."""
    told = F.array_sort(F.collect_list(F.when(F.col("fired"), F.struct("ord", "reason"))))
    rows = guards.groupBy(key).agg(F.max(F.coalesce("fired", F.lit(False))).alias("warning"), told.alias("t"))
    return rows.select(key, "warning", F.array_join(F.array_distinct(F.transform("t", lambda t: t["reason"])), "; ").alias("banner"))


Grader = Callable[[np.ndarray], np.ndarray]


def saliency(x: np.ndarray, grade: Grader, fs: float, patch: float = 0.12, full: float = 0.25, floor: float = 0.02) -> np.ndarray:
    """How much P(unusable) moves when a patch is replaced by a straight line: per sample, the most over its patches,
    as a share of `full`; less than `floor` is nothing. All patches are graded in one batch."""
    x = np.nan_to_num(np.asarray(x, float))
    n = len(x)
    if n < 8 or x.std() < 1e-9:
        return np.zeros(n)
    width = max(8, int(0.5 * fs), int(patch * n))
    reach = max(4, width // 4)
    cuts = [(s, min(n, s + width)) for s in range(0, n, max(1, width // 2))]
    tries = np.repeat(x[None], len(cuts) + 1, 0)
    for row, (s, e) in zip(tries, cuts, strict=False):
        before = x[max(0, s - reach) : s].mean() if s else x[s]
        after = x[e : e + reach].mean() if e < n else x[e - 1]
        row[s:e] = np.linspace(before, after, e - s)
    unusable = 1 - grade(tries)[:, -2:].sum(1)
    out = np.zeros(n)
    for (s, e), d in zip(cuts, np.abs(unusable[:-1] - unusable[-1]), strict=True):
        out[s:e] = np.maximum(out[s:e], d)
    return np.where(out < floor, 0.0, np.clip(out / full, 0, 1))


def group_shapley(value: Callable[[np.ndarray], np.ndarray], have: np.ndarray, reference: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Exact Shapley values of feature groups: every coalition is valued once, in one batch."""
    g = len(groups)
    feats = np.repeat(reference[None].astype(float), 2**g, 0)
    for s in range(2**g):
        for k in range(g):
            if s >> k & 1:
                feats[s, groups[k]] = have[groups[k]]
    v, phi = value(feats), np.zeros(g)
    for k in range(g):
        others = [o for o in range(g) if o != k]
        for size in range(g):
            weight = factorial(size) * factorial(g - size - 1) / factorial(g)
            for chosen in combinations(others, size):
                s = sum(1 << o for o in chosen)
                phi[k] += weight * (v[s | 1 << k] - v[s])
    return phi


def narrative(tier: Column, label: Column, seconds: Column, at: Column, spread: Column, peak: Column, lead: Column, phi: Column, artifacts: Column) -> Column:
    """A sentence on where, why and what: at is the place of the peak in seconds, spread the share of the window above
    half of it, lead the group with the greatest attribution phi."""
    head = F.format_string("Graded %s (%s) over this %.1f s window.", label, tier, F.greatest(seconds, F.lit(0.0)))
    where = F.when(peak >= 0.35, F.when(spread > 0.45, "the model responds across much of the window").otherwise(F.format_string("the model focuses on a region ≈%.1f s in", at)))
    driven = F.when(phi >= 0, "driven mainly by the").otherwise("held up mainly by the")
    why = F.when(lead.isNull(), None).when(F.abs(phi) < 0.05, "no single quality property stands out").otherwise(F.concat(F.lit("the grade is "), driven, F.lit(" "), lead, F.lit(" quality features")))
    what = F.when(F.size(artifacts) > 0, F.concat(F.lit("tagged as "), F.array_join(F.slice(artifacts, 1, 2), " and ")))
    body = F.concat_ws(", ", where, why, what)
    return F.when(body == "", head).otherwise(F.concat(head, F.lit(" "), F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2), F.length(body)), F.lit(".")))
