"""Token ids in a content-addressed store.

A rolling hash over the last 16 ids cuts each document's id stream into chunks, so that equal passages give equal chunks
wherever they stand. A chunk is stored once, under the hash of its bytes. A document is a recipe: its chunk hashes in
order. Recipes are written in ascending id order with the ids of all documents before, and a Merkle tree over them (256
children a node) gives a root that a reader recomputes.

    folder/store/kind=chunk     hash, n, ids     ids: `width` bytes each, little-endian
    folder/recipes              doc_id, n_tokens, hashes, rank, start (sorted by doc_id)
    folder/manifest             root, n_docs, n_tokens, width

Null or empty text: the end id only. Null id: before all others. Repeated ids or rows: each has a recipe of its own, in
order of the recipe's hash. Very long texts: their ids are held once by a task. A vocabulary whose ids do not fit the
files' width is refused. Empty table: no recipe, and the root of nothing. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, running_sums, written
from .tokens import encoder, vocabulary

#: Ids that the rolling hash sees, and chunk lengths: least, mean beyond that, most.
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096
FAN_OUT = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Ends of the chunks of id streams that stand one after the other and end at `ends`.

    The rolling hash runs over all of them at once: what it takes from the stream before lies within LEAST ids of a
    stream's start, where no chunk ends.
    """
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    width = 1
    while width < WINDOW:  # sums over 2, 4, ... ids, the later ones shifted
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    marks = (np.flatnonzero((h * _MIX) >> np.uint64(32) < np.uint64(2**32 // MEAN)) + 1).tolist()
    out, k, at = [], 0, 0
    for end in ends:
        cuts = []
        while True:
            while k < len(marks) and marks[k] < at + LEAST:
                k += 1
            to = min(at + MOST, marks[k] if k < len(marks) else end)
            if to >= end:
                break
            cuts.append(to)
            at = to
        if at < end:
            cuts.append(end)
        out.append(cuts)
        at = end
    return out


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


_STAGED = "key binary, doc_id {kind}, n long, hashes array<binary>, ids binary, kind string"


def encoded(tokenizer: str, end_id: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows of _STAGED, recipes and then the chunks that are new to the task, of batches of (doc_id, text)."""
    end, stored = np.array([end_id], "<u4").tobytes(), f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), set()
        names = ["key", "doc_id", "n", "hashes", "ids", "kind"]
        for b in batches:
            streams = [enc.encode(text or "") + end for text in b.column(1).to_pylist()]
            sizes = [len(s) // 4 for s in streams]
            ids, ends = np.frombuffer(b"".join(streams), "<u4"), np.cumsum(sizes).tolist()
            packed, at = ids.astype(stored).tobytes(), 0  # sliced as bytes: pyarrow never frees a memoryview that it is given
            key, n, raw, recipes = [], [], [], []
            for cuts in cut_points(ids, ends):
                recipe = []
                for to in cuts:
                    chunk = packed[at * width : to * width]
                    h = _digest(chunk)
                    recipe.append(h)
                    if h not in seen:  # of a task's own repeats, one goes on
                        seen.add(h)
                        key.append(h)
                        n.append(to - at)
                        raw.append(chunk)
                    at = to
                recipes.append(recipe)
            keys = [_digest(repr(doc).encode() + b"".join(r)) for doc, r in zip(b.column(0).to_pylist(), recipes, strict=True)]
            m = len(keys)
            arrays = [pa.array(keys, pa.binary()), b.column(0), pa.array(sizes, pa.int64()), pa.array(recipes, pa.list_(pa.binary())), pa.nulls(m, pa.binary()), pa.array(["recipe"] * m)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            m = len(key)
            arrays = [pa.array(key, pa.binary()), pa.nulls(m, b.column(0).type), pa.array(n, pa.int64()), pa.nulls(m, pa.list_(pa.binary())), pa.array(raw, pa.binary()), pa.array(["chunk"] * m, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return encode


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int = 2, buckets: int | None = None) -> None:
    """Encode all documents and write the store. width: bytes of an id in the files, 2 for vocabularies below 65,536."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if (most := max(vocabulary(tokenizer), end_id + 1)) > 256**width:
        raise ValueError(f"ids below {most} do not fit {width} bytes")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:  # rows come sorted by key: a chunk that follows its like goes
            keys = b.column(0).to_pylist()
            keep = [what == "recipe" or k != before for k, before, what in zip(keys, [last, *keys], b.column(5).to_pylist(), strict=False)]
            last = keys[-1] if keys else last
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = _STAGED.format(kind=kind)
    staged = docs.select("doc_id", "text").mapInArrow(encoded(tokenizer, end_id, width), schema).repartition("key").sortWithinPartitions("key").mapInArrow(once, schema)
    staged.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/store")
    recipes = _staged(spark, folder, kind).filter("kind = 'recipe'").select("doc_id", "n", "hashes", "key")
    spread = F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("double") / 2.0**48  # keys are hashes, even over their range
    placed = running_sums(recipes.withColumn("one", F.lit(1)), "doc_id", {"start": "n", "rank": "one"}, ["key"], buckets, spread)
    placed.repartitionByRange(F.col("rank")).sortWithinPartitions("rank").select("doc_id", F.col("n").alias("n_tokens"), "hashes", "rank", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    root, n_docs, n_tokens = _root(read_recipes(spark, folder, kind))
    spark.createDataFrame([(root, n_docs, n_tokens, width)], "root string, n_docs long, n_tokens long, width int").coalesce(1).write.parquet(f"{folder}/manifest")


def _staged(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(_STAGED.format(kind=kind)).parquet(f"{folder}/store")


def read_recipes(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, n_tokens long, hashes array<binary>, rank long, start long").parquet(f"{folder}/recipes")


def _root(recipes: DataFrame) -> tuple[str, int, int]:
    """Merkle root over the recipes by rank: each node is the hash of up to FAN_OUT children."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens"), F.col("start"), F.concat_ws(",", F.transform("hashes", F.hex))).cast("binary"), 256)
    nodes = recipes.select("rank", leaf.alias("h"), F.lit(1).alias("n"), F.col("n_tokens").alias("t"))
    for _ in range(2):
        up = nodes.groupBy(F.floor(F.col("rank") / FAN_OUT).alias("rank"))
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]))
        nodes = up.agg(F.sha2(joined.cast("binary"), 256).alias("h"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    nodes = written(nodes, "merkle")
    while (n := nodes.count()) > 1:
        up = nodes.groupBy(F.floor(F.col("rank") / FAN_OUT).alias("rank"))
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]))
        nodes = written(up.agg(F.sha2(joined.cast("binary"), 256).alias("h"), F.sum("n").alias("n"), F.sum("t").alias("t")), "merkle")
    row = nodes.first() if n else None
    return (row["h"], row["n"], row["t"]) if row else (hashlib.sha256(b"").hexdigest(), 0, 0)


def verify_manifest(spark: SparkSession, folder: str, kind: str = "long") -> None:
    """Recompute the Merkle root from the recipe files; raises if it differs from the manifest."""
    told = spark.read.parquet(f"{folder}/manifest").first()
    found = _root(read_recipes(spark, folder, kind))
    if found != (told["root"], told["n_docs"], told["n_tokens"]):
        raise ValueError(f"the recipes in {folder} do not give the root in its manifest")


def _shift_tables() -> list[list[list[int]]]:
    """For k = 0, 1, ...: what 2^k zero ids (of four bytes) after it do to a CRC-32, by byte of the CRC."""
    step = [zlib.crc32(b"\0" * 4, 1 << i) ^ zlib.crc32(b"\0" * 4, 0) for i in range(32)]
    tables = []
    for _ in range(32):
        table = []
        for byte in range(4):
            row = [0] * 256
            for v in range(1, 256):
                low = (v & -v).bit_length() - 1
                row[v] = row[v & (v - 1)] ^ step[8 * byte + low]
            table.append(row)
        tables.append(table)
        step = [_apply(table, x) for x in step]
    return tables


def _apply(t: list[list[int]], c: int) -> int:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


_TABLES: list = []


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings one after the other, from (CRC-32, ids) of each; an id has four bytes."""
    if not _TABLES:
        _TABLES.extend(_shift_tables())
    crc = 0
    for c, n in parts:
        k = 0
        while n:
            if n & 1:
                crc = _apply(_TABLES[k], crc)
            n >>= 1
            k += 1
        crc ^= c
    return crc


def read_chunks(spark: SparkSession, folder: str, kind: str = "long", width: int = 2, with_ids: bool = False) -> DataFrame:
    """(hash, n, crc[, ids]) of the stored chunks; a chunk whose bytes do not give its hash raises."""
    prepare(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, n, wide = [], [], []
            raws = b.column(1).to_pylist()
            ids = memoryview(np.frombuffer(b"".join(raws), f"<u{width}").astype("<u4").tobytes())
            at = 0
            for h, raw in zip(b.column(0).to_pylist(), raws, strict=True):
                if _digest(raw) != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
                to = at + len(raw) // width * 4
                crc.append(zlib.crc32(ids[at:to]))
                n.append((to - at) // 4)
                if with_ids:
                    wide.append(bytes(ids[at:to]))
                at = to
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(wide, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "n", "crc", "ids"][: 3 + with_ids])

    return _staged(spark, folder, kind).filter("kind = 'chunk'").select("key", "ids").mapInArrow(check, "hash binary, n long, crc long" + ", ids binary" * with_ids)


def read_back(spark: SparkSession, folder: str, kind: str = "long", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files.

    Each stored chunk is read and checked once; recipes then join its length and CRC-32, from which that of the document
    follows. With ids, they join its bytes.
    """
    prepare(spark)
    verify_manifest(spark, folder, kind)
    width = spark.read.parquet(f"{folder}/manifest").first()["width"]
    parts = read_recipes(spark, folder, kind).select("rank", "doc_id", "start", "n_tokens", F.posexplode("hashes").alias("at", "part"))
    joined = parts.join(read_chunks(spark, folder, kind, width, with_ids), F.col("part") == F.col("hash"), "left")
    fields = ["at", "n", "crc"] + ["ids"] * with_ids
    whole = joined.groupBy("rank", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            crc = []
            for n, parts in zip(b["n_tokens"], b["parts"], strict=True):
                if any(p["n"] is None for p in parts) or sum(p["n"] for p in parts) != n:
                    raise ValueError("a recipe's chunks are not all in the store")
                crc.append(joined_crc([(p["crc"], p["n"]) for p in parts]))
            out = b[["doc_id", "start", "n_tokens"]].assign(ids_crc32=crc)
            yield out.assign(ids=[b"".join(p["ids"] for p in parts) for parts in b["parts"]]) if with_ids else out

    return whole.drop("rank").mapInPandas(join, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
