"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is mapped to the counts of set bits of its segments. The Manhattan distance of two such count vectors is
at most the Hamming distance of the fingerprints, so pairs within `distance` bits are found by a grid range-join on
count vectors: pairs of a grid cell whose vectors are within `distance` are verified on the bits. Grid cells are groups
of blocks of the vector: of `distance` + k blocks, k at least must agree exactly, whichever bits differ, so the cells are
the choices of k blocks. k follows the number of fingerprints, so that a cell holds a few of them at every size.

Only distinct fingerprints are compared; equal ones are linked by their smallest id. Fingerprints of cells with more than
`limit` members go on to a finer grid (2 k + 1), where such a crowd falls apart; they share no other task with the rest,
and a pair that meets in large cells only is still met there. Where the finest grid leaves large cells, these are cut
into tiles, and pairs of tiles are tasks. A task returns links that span the components of its fingerprints, never all
pairs. Components of the links come from alternating star contraction until nothing changes, with a table in the shared
folder after each round.

Null or empty text (no word): fingerprint zero, linked like any other. Fewer words than a shingle: one shingle of all.
Very long texts: their shingles are hashed in blocks. Null id: takes part; a component's id is its smallest id that is
not null, else null. Repeated rows: linked as equal. Empty table: empty result. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, drop_written, prepare, written

#: Shingles that are hashed at once; bounds memory for very long texts.
SHINGLES = 65536
#: Rows that a task compares at once, beyond the last whole cell.
CHUNK = 65536


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: words of lower-cased ASCII, a bit is set if it is in over half of the shingles' hashes."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        end = min(n, at + SHINGLES)
        if len(words) < width:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[at + k : end + k] for k in range(width)), strict=True))
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hashed: bool = False) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer; also text_hash if asked for."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            rest = [b.column(2)] if hashed else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), *rest], names=[id_col, "fp", *["text_hash"] * hashed])

    raw = F.col(text_col).cast("binary")
    return docs.select(id_col, raw.alias("raw"), *[F.xxhash64(raw)] * hashed).mapInArrow(run, f"{id_col} {kind}, fp long" + ", text_hash long" * hashed)


def grid(distance: int, agree: int, segment: int = 2) -> np.ndarray:
    """Bits of a vector that make each grid cell: `agree` of distance + agree blocks of segments."""
    n, blocks = 64 // segment, distance + agree
    edges = [round(i * n / blocks) * segment for i in range(blocks + 1)]
    parts = [(1 << edges[b + 1]) - (1 << edges[b]) for b in range(blocks)]
    return np.array([sum(chosen) for chosen in combinations(parts, agree)], np.uint64)


def embedded(fp: np.ndarray) -> np.ndarray:
    """The count vectors of two-bit segments, each in one number: counts 0, 1, 2 as 00, 01, 11, so that the Manhattan
    distance of two vectors is the number of bits in which their numbers differ."""
    even = np.uint64(0x5555555555555555)
    low, high = fp & even, (fp >> np.uint64(1)) & even
    return low | high | ((low & high) << np.uint64(1))


def linked(fp: np.ndarray, unit: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components which all pairs within `distance` make inside units; `unit` must be sorted.

    Rows are compared with the k-th after them, for all k at once: first the vectors, then the bits of what is left.
    """
    vector, root = embedded(fp), np.arange(len(fp))
    here, k, out = np.arange(max(0, len(fp) - 1)), 1, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while len(here):
        here = here[unit[here] == unit[here + k]]
        near = here[np.bitwise_count(vector[here] ^ vector[here + k]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= distance]
        for i in near[root[near] != root[near + k]].tolist():
            x, y = find(i), find(i + k)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, i + k))
        while (root[root] != root).any():
            root = root[root]
        k += 1
        here = here[here + k < len(fp)]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


#: Blocks that agree on the finest grid.
FINEST = 13


def agreeing(n: int, distance: int = 3, members: int = 16) -> int:
    """Blocks that must agree, two at least, so that a cell has about `members` of n fingerprints; counts of 64 bits hold
    48 bits of information."""
    return next((k for k in range(2, FINEST) if n / 2 ** (48 * k / (k + distance)) <= members), FINEST)


def cells(nodes: DataFrame, distance: int, agree: int) -> DataFrame:
    """(fp, unit): every fingerprint in each of its grid cells."""
    masks = grid(distance, agree)
    mixed = np.random.default_rng(agree).integers(1, 2**63, len(masks), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            unit = (embedded(fp)[:, None] & masks) * np.uint64(0x9E3779B97F4A7C15)
            unit = ((unit ^ (unit >> np.uint64(29))) + mixed) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(masks)).view(np.int64)), pa.array((unit ^ (unit >> np.uint64(32))).ravel().view(np.int64))], names=["fp", "unit"])

    return nodes.select("fp").repartition(bucket_count(nodes.sparkSession), "fp").mapInArrow(run, "fp long, unit long")


def links(nodes: DataFrame, distance: int = 3, limit: int = 512, agree: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints `fp`: verified links, enough of them to give the components of all links.

    `nodes` should be a written table."""
    prepare(nodes.sparkSession)
    agree, units = agree or agreeing(nodes.count(), distance), None
    while True:
        keyed = cells(nodes, distance, agree)
        large = keyed.groupBy("unit").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("unit").alias("_unit"), "n")
        large = written(large, "cells-large")
        if last := large.isEmpty():
            found = keyed
        else:
            found = keyed.join(large, F.col("unit") == F.col("_unit"), "left_anti")
            crowd = keyed.join(large, F.col("unit") == F.col("_unit"))
            if last := agree >= FINEST:  # all pairs of tiles of what is left
                tiles = F.ceil(F.col("n") / limit).cast("int")
                own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
                pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.xxhash64("unit", F.least(own, o), F.greatest(own, o)))
                found = found.unionByName(crowd.select("fp", F.explode(pairs).alias("unit")))
            else:
                nodes = written(crowd.select("fp").distinct(), "fingerprints-crowded")
        units = found if units is None else units.unionByName(found)
        if last:
            break
        agree = min(FINEST, 2 * agree + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def emit(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            a, b = linked(frame["fp"].to_numpy(np.int64).view(np.uint64), frame["unit"].to_numpy(), distance)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for frame in batches:  # rows come sorted by unit; the last unit may go on in the next batch
            if not len(frame):
                continue
            held.append(frame)
            if sum(map(len, held)) >= CHUNK and frame["unit"].iloc[0] != frame["unit"].iloc[-1]:
                whole = pd.concat(held)
                last = (whole["unit"] == whole["unit"].iloc[-1]).to_numpy()
                yield from emit(whole[~last])
                held = [whole[last]]
        if held:
            yield from emit(pd.concat(held))

    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b) but the components themselves, which are the smallest nodes
    that can be reached.

    Alternating large-star and small-star, until a round changes nothing: every round is joins and partial aggregates
    over the links that are left.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        then = written(small, "links")
        stable = now.count() == then.count() and then.join(now, ["u", "v"], "left_anti").isEmpty()
        drop_written(now)
        now = then
        if stable:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _grouped(marked: DataFrame, id_col: str, distance: int) -> DataFrame:
    """The rows of `marked`, which have id and fp, with component (a fingerprint of it) and component_id."""
    nodes = written(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "fingerprint-nodes")
    found = written(links(nodes, distance), "fingerprint-links")
    parts = components(found)
    drop_written(found)
    # the smallest id of a component, from the smallest of each fingerprint
    parts = written(parts.union(parts.select(F.col("component").alias("node"), "component").distinct()), "parts")
    named = parts.join(nodes, F.col("node") == F.col("fp"))
    roots = named.groupBy("component").agg(F.min("first").alias("component_id"))
    moved = named.join(roots, "component").select("node", "component", "component_id")
    whole = nodes.join(moved, F.col("fp") == F.col("node"), "left")
    whole = whole.select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id"))
    # written, so that the join below is of two plain sides: Spark splits a fingerprint that many rows have
    whole = written(whole, "fingerprint-components")
    drop_written(nodes), drop_written(parts)
    return marked.join(whole, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, component_id): documents of a chain of links share the smallest id of the chain."""
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return _grouped(marked, id_col, distance).select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, whatever its ids: that with the smallest id,
    null being last; of repeated rows of that id, one. Rows are told apart by id and hash of the text."""
    marked = written(fingerprints(docs, id_col, text_col, hashed=True), "fingerprints")
    found = _grouped(marked, id_col, distance).groupBy("component", id_col, "text_hash").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.col("n"))).alias("best")
    keep = found.groupBy("component").agg(best).select(F.col("best.id").alias("__id"), F.col("best.hash").alias("__hash"), F.col("best.n").alias("__n"))
    keep = written(keep, "kept")
    # ids grow with the documents: they are shuffled, never broadcast, and the join builds on them, not on the texts
    whole, names = docs.select(F.struct(*docs.columns).alias("doc")), docs.columns  # other columns may have any names
    same = F.col(f"doc.`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"doc.`{text_col}`").cast("binary")) == F.col("__hash"))
    out = whole.join(keep.hint("shuffle_hash"), same)
    if not keep.filter("__n > 1").isEmpty():
        out = out.dropDuplicates(["__id", "__hash"])
    return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in names))
