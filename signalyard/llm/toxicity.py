"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words in lower case, and the first five and seven letters of longer words, so that
unseen endings still count. Terms are hashed into 2^32 buckets; the score is the logistic of a bias, one weight per term, and
the dot products of the factors of all pairs of terms. The pairs are what a linear model lacks: an insult beside the
mention of a group counts for more than the two by themselves. Terms have weights if enough training documents hold them and
they differ between the classes, by themselves or beside another term: a pair of terms whose documents are toxic more (or
less) often than either term and the sum of both tell. The others are left out, so long clean texts do not add up.

The model is fitted on at most `sample` labelled documents, by hash order of their ids; that bounds
what the driver holds, as only terms of these are weighed. Whole texts are scored. Null or empty text: the bias alone. Null labels do not train. Null ids:
scored, never trained on. Repeated rows are scored each. Without labels of both kinds, every score is 0. Other columns
are not read. Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: What is taken off both ends of a word.
_MARKS = "".join(map(chr, range(33, 48))) + "0123456789:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"


@dataclass
class Machine:
    """bias; keep: buckets with weights, ascending; weight[i], factors[i]: of the i-th of them."""

    bias: float
    keep: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def places(self, buckets: np.ndarray) -> np.ndarray:
        """Where the buckets that have weights are in keep."""
        if not len(self.keep):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keep, buckets), len(self.keep) - 1)
        return at[self.keep[at] == buckets]

    def margin(self, buckets: np.ndarray) -> float:
        at = np.unique(self.places(buckets))
        v = self.factors[at]
        return float(self.bias + self.weight[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum())


def terms(raw: bytes | None) -> set[str]:
    """The terms of a text."""
    tokens = set((raw or b"").decode("utf-8", "replace").lower().split())
    words = {t.strip(_MARKS) for t in tokens}
    words.discard("")
    words.update([w[:5] + "*" for w in words if len(w) > 5], [w[:7] + "*" for w in words if len(w) > 7])
    return words


def hashed(raw: bytes | None) -> np.ndarray:
    """Buckets of a text's terms."""
    found = terms(raw)
    return np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found))


def _deviance(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Root of the deviance of k of n at the rate p, which unlike a z-score does not swell where few are expected."""
    with np.errstate(divide="ignore", invalid="ignore"):
        yes, no = np.where(k > 0, k * np.log(k / (n * p)), 0), np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - p))), 0)
    return np.sqrt(np.maximum(2 * (yes + no), 0))


def paired(rows: list[np.ndarray], labels: np.ndarray, found: np.ndarray, seen: np.ndarray, in_pos: np.ndarray, together: float, tile: int = 512) -> np.ndarray:
    """Terms, of `found`, that differ between the classes beside another term, whatever they do alone.

    The toxic share of the documents with both is held against the shares of either and the sum of their log odds; the
    deviance from the nearest of these counts. Terms with too few documents for a deviance of `together` are not counted.
    """
    base = labels.mean()
    some, others = together**2 / (2 * np.log(1 / base)), together**2 / (2 * np.log(1 / (1 - base)))
    chosen = np.flatnonzero((in_pos >= some) | (seen - in_pos >= others))
    ids, n, out = found[chosen], len(chosen), np.zeros(len(found), bool)
    if n < 2:
        return out
    held = Machine(0.0, ids, np.zeros(0), np.zeros((0, 0)))
    placed = [np.unique(held.places(r)) for r in rows]
    share = (in_pos[chosen] + base) / (seen[chosen] + 1)
    odds, best = np.log(share / (1 - share)), np.zeros(n)
    for at in range(0, n, tile):
        wide = min(tile, n - at)
        counts = {1: np.zeros((wide, n - at), np.float32), 0: np.zeros((wide, n - at), np.float32)}
        for kind, count in counts.items():
            own = np.flatnonzero(labels == kind)
            for start in range(0, len(own), 1024):
                has = np.zeros((min(1024, len(own) - start), n - at), np.float32)
                for i, d in enumerate(own[start : start + 1024]):
                    has[i, placed[d][np.searchsorted(placed[d], at) :] - at] = 1
                count += has[:, :wide].T @ has
        for i in range(wide):
            k, both = counts[1][i, i + 1 :].astype(float), (counts[0][i, i + 1 :] + counts[1][i, i + 1 :]).astype(float)
            j = np.flatnonzero(both >= min(some, others))
            k, both, j = k[j], both[j], j + at + i + 1
            told = np.stack([np.full(len(j), share[at + i]), share[j], 1 / (1 + np.exp(np.log(base / (1 - base)) - odds[at + i] - odds[j]))])
            high, low = told.max(0), told.min(0)
            gap = np.where(k > both * high, _deviance(k, both, high), np.where(k < both * low, _deviance(k, both, low), 0))
            best[j] = np.maximum(best[j], gap)
            best[at + i] = max(best[at + i], gap.max(initial=0))
    out[chosen[best >= together]] = True
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, least: int = 4, apart: float = 5.5, pure: float = 0.0, together: float = 6.5, epochs: int = 100, batch: int = 256, rate: float = 0.5, decay: float = 1e-5, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss. Classes weigh as they occur, so that scores are probabilities."""
    y, n = labels.astype(float), len(labels)
    pos = int(y.sum())
    if n == 0 or pos in (0, n):
        return Machine(-50.0, np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, rank)))
    found, seen = np.unique(np.concatenate(rows), return_counts=True)
    some, often = np.unique(np.concatenate([r for r, q in zip(rows, labels.tolist(), strict=True) if q]), return_counts=True)
    in_pos = np.zeros(len(found))
    in_pos[np.searchsorted(found, some)] = often
    base = pos / n
    z = (in_pos - seen * base) / np.sqrt(seen * base * (1 - base))
    alone = (np.abs(z) >= apart) & (np.maximum(in_pos, seen - in_pos) >= pure * seen)
    keep = found[(seen >= least) & (alone | paired(rows, labels, found, seen, in_pos, together))]
    machine = Machine(0.0, keep, np.zeros(0), np.zeros((0, rank)))
    placed = [np.unique(machine.places(r)) for r in rows]
    owner, flat = np.repeat(np.arange(n), [len(p) for p in placed]), np.concatenate(placed)
    starts = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(keep)), rng.normal(0, 0.02, (len(keep), rank)), float(np.log(base / (1 - base)))
    gw, gv, gb = np.full(len(keep), 1e-6), np.full((len(keep), rank), 1e-6), 1e-6
    for _ in range(epochs if len(keep) else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in own])
            seg = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            sums = np.stack([np.bincount(seg, v[idx, f], len(own)) for f in range(rank)], 1)
            squares = np.bincount(seg, (v[idx] ** 2).sum(1), len(own))
            m = b + np.bincount(seg, w[idx], len(own)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[own]) / len(own)
            d = slope[seg]
            dw = np.bincount(idx, d, len(keep)) + decay * w
            dv = np.stack([np.bincount(idx, d * (sums[seg, f] - v[idx, f]), len(keep)) for f in range(rank)], 1) + decay * v
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + slope.sum() ** 2
            w, v, b = w - rate * dw / np.sqrt(gw), v - rate * 0.05 * dv / np.sqrt(gv), b - rate * 0.1 * slope.sum() / np.sqrt(gb)
    return Machine(b, keep, w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", label_col: str = "toxic", **how) -> Machine:
    """Fit on labelled documents, of which `sample` at most are taken, by hash of the id."""
    prepare(docs.sparkSession)
    told = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    chosen = told.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(id_col, F.col("text").cast("binary").alias("raw")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [hashed(x).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), b.column(2)], names=["id", "b", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select(id_col, "raw", "y").mapInArrow(run, f"id {kind}, b binary, y int").collect()
    got.sort(key=lambda r: (r["id"], r["y"]))
    return fit([np.frombuffer(r["b"], np.uint32) for r in got], np.array([r["y"] for r in got], np.int64), **how)


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every document. The model, whose size the bound on the sample limits, is broadcast."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            margins = np.array([m.margin(hashed(x)) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"{id_col} {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
