"""Best-fit packing into sequences with several capacities.

A document's ids are cut only if they exceed a sequence: into full pieces, of which the first may be shorter. Pieces are
packed longest first. Every open sequence has a residual vector (tokens, documents, attention cost); a piece may go where
no residual would be negative, and goes where the weighted norm of what is left is least, or where the weighted dot
product of its needs and the residuals is greatest. If it fits nowhere, a sequence is opened.

Pieces are dealt at random to shards of about `shard` pieces, each packed by one task, so no task grows with the input;
what this costs is one sequence that is not full in each shard.

Null or empty text: the end id only. Null id: packed as any other. Repeated ids or rows: each is packed. Ties in length
go by id and piece. Empty table: empty result. Other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .tokens import encoder


@dataclass(frozen=True)
class Capacity:
    """Of a sequence: tokens, documents, attention cost (sum of squared piece lengths); weights of the three in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of all documents."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = enc.encode(text or "") + end
                n = len(raw) // 4
                first = n if n <= tokens else n % tokens or tokens
                at = 0
                for piece, to in enumerate(range(first, n + 1, tokens)):
                    part = raw[4 * at : 4 * to]
                    rows.append((doc, piece, at, to - at, zlib.crc32(part), part))
                    at = to
            kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: len(names)], names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; `lengths` must be in descending order."""
    w, full = np.array(cap.weights, float), np.array([cap.tokens, cap.documents, cap.attention], float)
    left = np.empty((3, max(1, len(lengths))))
    names = np.empty(max(1, len(lengths)), np.int64)
    open_, made = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = (n, 1, n * n)
        if any(x > y for x, y in zip(need, full, strict=True)):
            raise ValueError(f"a piece of {n} tokens exceeds a sequence's capacity")
        t, d, a = left[0, :open_], left[1, :open_], left[2, :open_]
        fits = np.flatnonzero((t >= n) & (d >= 1) & (a >= n * n))
        if len(fits):
            if cap.rule == "dot":
                score = -(w[0] * n * t[fits] / full[0] ** 2 + w[1] * d[fits] / full[1] ** 2 + w[2] * n * n * a[fits] / full[2] ** 2)
            else:
                score = w[0] * ((t[fits] - n) / full[0]) ** 2 + w[1] * ((d[fits] - 1) / full[1]) ** 2 + w[2] * ((a[fits] - n * n) / full[2]) ** 2
            k = int(fits[np.argmin(score)])
        else:
            k = open_
            left[:, k], names[k] = full, made
            open_, made = open_ + 1, made + 1
        bins[i], offsets[i] = names[k], int(full[0] - left[0, k])
        left[:, k] -= need
        if left[0, k] < least or left[1, k] < 1:  # nothing more can go there
            open_ -= 1
            left[:, k], names[k] = left[:, open_], names[open_]
    return bins, offsets


def pack(items: DataFrame, cap: Capacity = Capacity(), shard: int = 4096) -> DataFrame:
    """`items` (with doc_id, piece, length) with sequence_id and offset. `items` should be a written table."""
    prepare(items.sparkSession)
    shards = max(1, -(-items.count() // shard))
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    names = items.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(np.int64), cap)
        return frame[names].assign(sequence_id=(frame["_shard"].to_numpy(np.int64) << 32) + bins, offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """All documents in sequences: a row per piece, with its place, and its ids if asked for."""
    return pack(written(pieces(docs, tokenizer, cap.tokens, with_ids=with_ids), "pieces"), cap)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from packed pieces with ids; a sequence has at most its capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
