"""Removal of repeated passages by a hash-compared suffix sort.

Every byte covered by a string of `depth` bytes that also starts elsewhere, in the same text or another, goes. Windows of
that length are dealt by their anchor: the leftmost of their `gram`-byte strings with the least hash. Equal windows have
equal anchors at equal places, so only texts around equal anchors need be compared. Anchors with equal surroundings (all
windows they own) are a class; one of a class is sorted, or two if there are more, and what the sort finds holds for all.

The suffixes that begin at the anchor are sorted, and so are the reversed prefixes that end there: a mergesort whose
comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes. Common extensions
of neighbours in the order are verified on the bytes; where hashes collide, the bytes are sorted. A window that begins s
bytes before its anchor is repeated if another anchor shares s bytes to the left and depth - s to the right, which the
two orders tell for all anchors at once.

A task sorts whole groups of equal anchors. A group of more than `limit` rows is dealt anew: by quarters of the range of
s and by the bytes that all windows of such a quarter share, which tells most of its rows apart; what is still large is
quartered again, down to single windows, which are counted by their bytes. A row is so sent at most once per window,
whatever the size of its group, and no pair of rows is ever formed.

Null or empty text: nothing to remove. Null id: its row is kept; rows are told apart by id and hash of the text. Repeated
rows: they repeat each other's strings. Very long texts are cut into blocks of windows; their bytes are held once by a
task. Empty table: empty result. Other columns are not read. Classes are told apart by 128-bit hashes.
"""
from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, prepare, written

_BASE, _MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Windows of a text that are dealt at once.
BLOCK = 1 << 22
#: Rows that a task sorts at once, beyond the last whole group.
CHUNK = 16_384


def anchors(raw: bytes, depth: int = 200, gram: int = 32) -> tuple[np.ndarray, ...]:
    """(anchor, lo, hi, hash of the anchor's gram): windows that start at lo..hi have their anchor there."""
    x, out = np.frombuffer(raw, np.uint8), []
    width, last = depth - gram + 1, len(raw) - depth
    for begin in range(0, last + 1, BLOCK):
        end = min(last + 1, begin + BLOCK)
        h, p, w = _BYTES[x[begin : end - 1 + depth]], _BASE, 1
        while w < gram:
            h = h[:-w] * np.uint64(p) + h[w:]
            p, w = p * p % 2**64, 2 * w
        k = h * np.uint64(_MIX)
        k ^= k >> np.uint64(32)
        k = (k * np.uint64(_MIX)) & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            k = np.minimum(k[:-w], k[w:])
            w *= 2
        n = end - begin
        at = (np.minimum(k[:n], k[width - w : width - w + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:], n] - 1
        out.append((at[lo] + begin, lo + begin, hi + begin, h[at[lo]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


class Suffixes:
    """Byte strings with O(log) comparison by prefix polynomial hashes."""

    def __init__(self, strings: list[bytes]) -> None:
        self.length = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.text = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(self.text), _BASE, np.uint64)])
        self.prefix = np.r_[np.uint64(0), np.cumsum(_BYTES[self.text] * power[:-1])]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(self.text), pow(_BASE, -1, 2**64), np.uint64)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j, by binary search."""
        p, q = self.at[i], self.at[j]
        least, most = np.zeros(len(p), np.int64), np.minimum(self.length[i], self.length[j])
        while len(p) and (most > least).any():
            mid = (least + most + 1) >> 1
            same = (self.prefix[p + mid] - self.prefix[p]) * self.back[p] == (self.prefix[q + mid] - self.prefix[q]) * self.back[q]
            least, most = np.where(same, mid, least), np.where(same, most, mid - 1)
        return least

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i comes before string j."""
        n = self.common(i, j)
        a, b = self.length[i] > n, self.length[j] > n  # characters left
        return np.where(a & b, self.text[np.where(a, self.at[i] + n, 0)] < self.text[np.where(b, self.at[j] + n, 0)], ~a & b)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Strings sorted within groups; `group` must ascend. Bottom-up mergesort: all pairs of runs of a level at once, an
        element's place being its rank in the other run."""
        n = len(group)
        now, width = np.arange(n), 1
        spot = np.arange(n)
        while width < n:
            run = spot // width
            left = run % 2 == 0
            other = np.where(left, (run + 1) * width, (run - 1) * width)
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            # only the group that lies across the two runs needs comparisons
            edge = np.minimum((run + left) * width, n - 1)
            across = (group[now] == group[now[edge]]) & (group[now] == group[now[np.maximum(edge - 1, 0)]]) & (high > low)
            low, high = np.where(across, low, np.where(left, low, high)), np.where(across, high, np.where(left, low, high))
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) >> 1
                mine, its, own_left = now[active], now[mid], left[active]
                same = group[its] == group[mine]
                before = group[its] < group[mine]  # the other element comes first
                k = np.flatnonzero(same)
                if len(k):
                    l = own_left[k]
                    first = np.where(l, its[k], mine[k])
                    second = np.where(l, mine[k], its[k])
                    ahead = self.less(first, second)  # left: the other is less; right: own is less, else the other is first or equal
                    before[k] = np.where(l, ahead, ~ahead)
                low[active], high[active] = np.where(before, mid + 1, low[active]), np.where(before, high[active], mid)
                active = active[low[active] < high[active]]
            start = np.where(left, run, run - 1) * width
            rank = low - other
            place = start + (spot - run * width) + np.where(other >= n, 0, rank)
            merged = np.empty_like(now)
            merged[place] = now
            now, width = merged, 2 * width
        return now

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common prefix of each string in order with the one before, -1 at the start of a group, and whether the bytes
        bear it out: what is common is equal, and the strings ascend after it."""
        out, true = np.full(len(order), -1, np.int64), True
        k = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        i, j = order[k - 1], order[k]
        n = self.common(i, j)
        for at in range(0, len(k), 4096):
            a, b, m = i[at : at + 4096], j[at : at + 4096], n[at : at + 4096]
            col = np.arange(int(m.max()) if len(m) else 0)
            same = self.text[np.minimum(self.at[a][:, None] + col, len(self.text) - 1)] == self.text[np.minimum(self.at[b][:, None] + col, len(self.text) - 1)]
            true &= bool((same | (col >= m[:, None])).all())
        out[k] = n
        return out, true


def sorted_by_bytes(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes without hashes, for groups whose hashes collide."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])), np.int64)
    out = np.full(len(order), -1, np.int64)
    for k in range(1, len(order)):
        if group[order[k]] == group[order[k - 1]]:
            out[k] = len(os.path.commonprefix([strings[order[k - 1]], strings[order[k]]]))
    return order, out


def repeated(strings: list[bytes], anchor: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest start of the windows of each string that another string of its group has at the same distance
    from its anchor; (1, 0) where there is none. `group` must ascend."""
    n = len(strings)
    length = np.array([len(s) for s in strings], np.int64)
    classes = []
    for part in ([s[a:] for s, a in zip(strings, anchor.tolist(), strict=True)], [s[:a][::-1] for s, a in zip(strings, anchor.tolist(), strict=True)]):
        suffixes = Suffixes(part)
        order = suffixes.order(group)
        common, true = suffixes.neighbours(order, group)
        classes.append((order, common) if true else sorted_by_bytes(part, group))
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(int(anchor.max(initial=-1)) + 1):
        own = np.flatnonzero((anchor >= s) & (anchor - s + depth <= length))
        if len(own) < 2:
            continue
        right[classes[0][0]] = np.cumsum(classes[0][1] < depth - s)
        left[classes[1][0]] = np.cumsum(classes[1][1] < s)
        key = right[own] * (n + 1) + left[own]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = own[by[np.r_[same, False] | np.r_[False, same]]]
        start = anchor[hit] - s
        first[hit] = np.minimum(first[hit], start)
        last[hit] = np.maximum(last[hit], start)
    none = last < 0
    return np.where(none, 1, first), np.where(none, 0, last)


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 200, gram: int = 32, limit: int = 512) -> DataFrame:
    """(id, t, start, end): stretches of repeated bytes of the text with hash t; they may overlap."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = hashed(docs, id_col, text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t, columns, sums = [], [], [], []
            for doc, raw, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if raw is None or len(raw) < depth:
                    continue
                found = anchors(raw, depth, gram)
                view = memoryview(raw)
                sums.extend(xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(found[1].tolist(), (found[2] + depth).tolist(), strict=True))
                ids.extend([doc] * len(found[0]))
                t.append(np.full(len(found[0]), h, np.int64))
                columns.append(found)
            if columns:
                at, lo, hi, g = (np.concatenate(c) for c in zip(*columns, strict=True))
                both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
                arrays = [pa.array(ids, b.column(0).type), *map(pa.array, (np.concatenate(t), at, lo, hi, g.view(np.int64), both[:, 0].copy(), both[:, 1].copy()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "t", "at", "lo", "hi", "g", "h1", "h2"])

    every = written(texts.mapInArrow(mark, f"id {kind}, t long, at long, lo long, hi long, g long, h1 long, h2 long"), "anchors")
    twice = written(every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("g").alias("_g")), "anchors-twice")
    some = written(every.join(twice, F.col("g") == F.col("_g"), "left_semi"), "anchors-some")
    _release(spark)
    drop_written(every), drop_written(twice)
    place = F.struct("id", "t", "at", "lo", "hi")
    kinds = written(some.groupBy("g", "h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max(place).alias("two")), "surroundings")
    sizes = kinds.groupBy("g").agg(F.sum(F.least("c", F.lit(2))).alias("n")).filter(F.col("n") > limit)
    large = written(sizes.select(F.col("g").alias("_g"), "n"), "anchors-large")
    both = F.when(F.col("c") > 1, F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p")), F.struct(F.lit(1).alias("copy"), F.col("two").alias("p")))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p"))))
    rows = kinds.join(large, F.col("g") == F.col("_g"), "left").select("g", "h1", "h2", F.col("n").isNotNull().alias("large"), F.explode(both).alias("b"))
    rows = rows.select("b.p.*", "g", "h1", "h2", "large", "b.copy")
    wanted = rows.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("at", "lo", "hi", "g", "h1", "h2", "large", "copy")).alias("want"))
    joined = texts.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for raw, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.extend((w["g"], w["h1"], w["h2"], w["copy"], w["large"], w["at"] - w["lo"], raw[w["lo"] : w["hi"] + depth]) for w in want)
            kinds_ = [*[pa.int64()] * 3, pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names=["g", "h1", "h2", "copy", "large", "a", "text"])

    around = joined.select("raw", "want").mapInArrow(fetch, "g long, h1 long, h2 long, copy int, large boolean, a long, text binary")
    around = around.withColumn("off", F.lit(0).cast("long"))
    unit = ["unit", "g", "h1", "h2", "copy", "a", "off", "text"]
    if large.isEmpty():
        units, settled = around.withColumn("unit", F.col("g")).select(unit), []
    else:
        around = written(around, "around")
        units = around.filter("not large").withColumn("unit", F.col("g")).select(unit)
        hot = around.filter("large").withColumn("unit", F.col("g")).withColumn("s0", F.lit(0)).withColumn("s1", F.lit(depth - gram)).drop("large")
        small, settled = _quartered(hot, depth, limit)
        for part in small:
            units = units.unionByName(part.select(unit))

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def emit(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            frame = frame[~frame.duplicated(["unit", "g", "h1", "h2", "copy", "off"])]  # of repeated rows, one
            unit = frame["unit"].to_numpy()
            group = np.cumsum(np.r_[True, unit[1:] != unit[:-1]])
            several = np.bincount(group)[group] > 1
            frame, group = frame[several], group[several]
            if len(frame):
                first, last = repeated(frame["text"].tolist(), frame["a"].to_numpy(np.int64), group, depth)
                off = frame["off"].to_numpy(np.int64)
                out = frame[["g", "h1", "h2"]].assign(first=off + first, last=off + last)
                yield out[(last >= first) & (frame["copy"] == 0).to_numpy()]

        for frame in batches:
            if not len(frame):
                continue
            held.append(frame)
            if sum(map(len, held)) >= CHUNK:
                whole = pd.concat(held)
                tail = (whole["unit"] == whole["unit"].iloc[-1]).to_numpy()
                if not tail.all():
                    yield from emit(whole[~tail])
                    held = [whole[tail]]
        if held:
            yield from emit(pd.concat(held))

    found = units.repartition("unit").sortWithinPartitions("unit").mapInPandas(sort, "g long, h1 long, h2 long, first long, last long")
    for part in settled:
        found = found.unionByName(part)
    found = found.groupBy("g", "h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = written(found.select(F.col("g").alias("_g"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first", "last"), "repeats-found")
    _release(spark)
    drop_written(kinds), drop_written(large)
    every_one = some.join(found, (F.col("g") == F.col("_g")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    return every_one.select("id", "t", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + depth).alias("end"))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, t): texts as bytes, and a hash that tells rows of an id, or without one, apart."""
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return raw.withColumn("t", F.xxhash64("raw"))


def _quartered(hot: DataFrame, depth: int, limit: int, broadcast_rows: int = 50_000) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of large units dealt to smaller ones: (rows of units of at most `limit`, results that are settled).

    A unit has rows whose windows begin s0..s1 bytes before the anchor. All windows of a part [p0, p1] of that range share
    p0 bytes before the anchor and depth - p1 from it on, so rows that differ there go to different units. Rows that are
    equal over all of a part are settled there, and one of them goes on for the others.
    """
    small, settled, one = [], [], ["unit", "s0", "s1", "a", "text"]
    while True:
        step = F.greatest(F.lit(1), F.ceil((F.col("s1") - F.col("s0") + 1) / 4)).cast("int")
        part = lambda p: F.struct(p.alias("p0"), F.least(p + step - 1, F.col("s1")).alias("p1"), F.greatest(p, (F.col("a") + depth - F.length("text")).cast("int")).alias("least"), F.least(p + step - 1, F.col("s1"), F.col("a").cast("int")).alias("most"))  # noqa: B023, E731
        parts = F.filter(F.transform(F.sequence(F.col("s0"), F.col("s1"), step), part), lambda p: p["least"] <= p["most"])
        rows = hot.withColumn("p", F.explode(parts))
        shared = F.substring(F.col("text"), (F.col("a") - F.col("p.p0") + 1).cast("int"), (F.col("p.p0") + depth - F.col("p.p1")).cast("int"))
        cut = F.substring(F.col("text"), (F.col("a") - F.col("p.most") + 1).cast("int"), (F.col("p.most") + depth - F.col("p.least")).cast("int"))
        rows = rows.select("g", "h1", "h2", "copy", F.xxhash64("unit", "p.p0", "p.p1", shared).alias("unit"), F.col("p.p0").alias("s0"), F.col("p.p1").alias("s1"), (F.col("off") + F.col("a") - F.col("p.most")).alias("off"), F.col("p.most").cast("long").alias("a"), cut.alias("text"))
        rows = written(rows, "quarters")
        whole = written(rows.groupBy(*one).agg(F.count("*").alias("n"), F.min(F.struct("copy", "g", "h1", "h2", "off")).alias("r")), "quarters-once")
        equal = whole.filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in one))
        same = (F.col("unit") == F.col("_unit")) & (F.col("a") == F.col("_a")) & (F.col("text") == F.col("_text"))
        told = rows.filter("copy = 0").join(F.broadcast(equal) if equal.count() <= broadcast_rows else equal, same, "left_semi")
        settled.append(written(told.select("g", "h1", "h2", F.col("off").alias("first"), (F.col("off") + F.length("text") - depth).alias("last")), "quarters-settled"))
        sizes = whole.filter("s0 < s1").groupBy("unit").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("unit").alias("_unit"), "k")
        left = whole.filter("s0 < s1").join(written(sizes, "quarter-sizes"), F.col("unit") == F.col("_unit"))
        left = left.select(*one, "k", "r.g", "r.h1", "r.h2", "r.off", F.when(F.col("n") > 1, 1).otherwise(F.col("r.copy")).alias("copy"))
        left = written(left, "quarters-left")
        small.append(left.filter(F.col("k") <= limit))
        hot = left.filter(F.col("k") > limit)
        if hot.isEmpty():
            return small, settled


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 200, with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document; kept holds the bytes that stay."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    found = spans(docs, id_col, text_col, depth)
    # repeated rows have equal stretches, which a set holds once
    found = written(found.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("start", "end")).alias("gone")), "repeats")
    _release(spark)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    joined = hashed(docs, id_col, text_col).join(found.hint("shuffle_hash"), same, "left").select("id", "raw", "gone")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = raw or b""
                merged: list[list[int]] = []
                for s, e in sorted((g["start"], g["end"]) for g in gone or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                ends = [0, *(e for _, e in merged)]
                kept = b"".join(raw[a:s] for a, s in zip(ends, [*(s for s, _ in merged), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, types, strict=True)][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return joined.mapInArrow(cut, schema)
