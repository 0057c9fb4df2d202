"""Expressions on arrays: probabilities, prediction sets, moments and simple shape statistics."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def sanitize(p: Column) -> Column:
    """A row of probabilities with any value that is not finite becomes uniform."""
    bad = F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.transform(p, lambda v: 1.0 / F.size(p))).otherwise(p)


def confidence(p: Column) -> Column:
    return F.array_max(p)


def normalized_entropy(p: Column) -> Column:
    """-sum p ln p / ln k, probabilities clipped at 1e-12."""
    clip = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-12))
    return -total(F.transform(p, lambda v: clip(v) * F.ln(clip(v)))) / F.ln(F.size(p))


def argmax(p: Column) -> Column:
    """Index of the first greatest value, from 0."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / (total(e) + 1e-12))


def sigmoid(z: Column) -> Column:
    return F.transform(z, lambda v: 1.0 / (1.0 + F.exp(-v)))


def temperature_scale(p: Column, temperature: float) -> Column:
    """Offline only: graphs carry their temperature already."""
    return softmax(F.transform(p, lambda v: F.ln(F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-9))) / temperature))


def above(p: Column, labels: list[str], threshold: float, drop: tuple[str, ...] = ("clean",)) -> Column:
    """Labels whose probability reaches the threshold, in their order."""
    names = F.array(*map(F.lit, labels))
    hit = F.filter(F.zip_with(names, p, lambda n, v: F.struct(n.alias("n"), v.alias("v"))), lambda s: (s["v"] >= threshold) & ~s["n"].isin(*drop))
    return F.transform(hit, lambda s: s["n"])


def prediction_set(p: Column, labels: list[str], threshold: float) -> Column:
    """Most probable classes until their probabilities reach the threshold, in class order. A class is in if those that
    come before it, by probability and then by place, do not reach it."""
    names = F.array(*map(F.lit, labels))

    def before(v: Column, i: Column) -> Column:
        return total(F.transform(p, lambda u, j: F.when((u > v) | ((u == v) & (j < i)), u).otherwise(0.0)))

    keep = F.transform(p, lambda v, i: (before(v, i) < threshold - 1e-12) | (before(v, i) == 0.0))
    pairs = F.zip_with(names, keep, lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    return F.transform(F.filter(pairs, lambda s: s["k"]), lambda s: s["n"])


def bar(value: Column, good: float, bad: float) -> Column:
    """Where a value lies between a good and a bad anchor: 1 to 0."""
    return F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - good) / (bad - good)))


def haar(a: Column) -> tuple[Column, Column]:
    """Approximation and detail of one level; an odd sample at the end is left out."""
    half = F.floor(F.size(a) / 2).cast("int")
    at = lambda i: F.element_at(a, i.cast("int"))
    idx = F.sequence(F.lit(1), half)
    root = 2.0**0.5
    return F.transform(idx, lambda k: (at(2 * k - 1) + at(2 * k)) / root), F.transform(idx, lambda k: (at(2 * k - 1) - at(2 * k)) / root)


def diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)
