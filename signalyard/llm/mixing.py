"""Mixing sources to target weights: weighted fair queueing.

Every source has a target in words. Its documents are shuffled by a keyed hash and served one after the other, again
from the start if the target exceeds the source (up to `max_repeats` times). A service finishes at virtual time (words
of its source up to its end) / (target of its source), so all sources reach their targets at virtual time 1. The mix is
all services, over all sources, in order of finish time, cut at the budget: the sum of the targets. The service at the
cut is taken in part.

Whatever finishes by virtual time 1 is within the budget, as no source is then beyond its target. A document that is
still being served at that time is served in packets, each with a finish time of its own; so a very long document is
taken in part, and each source comes within about a packet of its target.

Null or empty text: size 0, never served. Null source: a source of its own, last. Null id: served as any other, dealt by
its text. Repeated ids or rows: each row is served by itself. Very long texts: counted whole, served in packets at the
cut. Empty table: empty result. Other columns are not read.

Scale: only (id, source, size, hash of the text) leaves the scan. Positions within a source come from sums per (source,
hash bucket) plus an ordering inside a bucket, so that a source with a third of all rows is spread over `buckets` tasks;
buckets and slots follow the number of rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, written

def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def target_words(sizes: Sequence[tuple[object, int]], weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> dict:
    """Targets by source. `sizes` has one entry per source; weights repeat over the sources by code point, null last.
    A target stops at max_repeats times its source; the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, str(x[0])))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, target = float(sum(size.values())), [s for s, n in order if n > 0], {s: 0.0 for s in size}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > max_repeats * size[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(max_repeats * size[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


#: Rows that a task orders at once, about; most ranges of such rows; rows that a broadcast table may have.
PIECE_ROWS, MOST_PIECES, BROADCAST_ROWS = 500_000, 65_536, 200_000

#: Words of a packet, in which documents are served that are not done by virtual time 1.
PACKET_WORDS = 32


def pieces_of(rows: DataFrame, least: int) -> int:
    """Into how many pieces rows are dealt to be ordered. `rows` should be a written table, whose count is at hand."""
    return min(MOST_PIECES, max(least, -(-rows.count() // PIECE_ROWS)))


def horizon(sizes: Sequence[tuple[object, int]], target: dict, max_repeats: int, packet: int) -> float:
    """A virtual time by which services that have begun make up the budget, though each source lags by a packet."""
    budget, over = sum(target.values()), packet / max(1.0, sum(target.values()))
    while sum(min((1 + over) * target[s] - packet, max_repeats * n) for s, n in sizes if n > 0) < budget:
        over *= 2
    return 1 + over


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, buckets: int | None = None, seed: int = 17) -> DataFrame:
    """The plan of the mix from rows with id, source, `size` and `text_hash`: one row per document with these and
    source_size, target, before (words of its source that are served before it, in a pass), budget (words of the mix)
    and horizon (see above).

    The number of sources is taken to fit on the driver, as weights are given by source.
    """
    buckets = buckets or pieces_of(docs, 256)
    rows = docs.select(id_col, source_col, "size", "text_hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col("text_hash")).alias("_k"))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_k", 32), F.lit(buckets)).cast("int"))
    sums = written(rows.groupBy(source_col, "_b").agg(F.sum("size").alias("_n")), "mix-sums")
    size = [(r[0], r[1]) for r in sums.groupBy(source_col).agg(F.sum("_n")).collect()]
    target = target_words(size, weights, max_repeats)
    budget, late = round(sum(target.values())), horizon(size, target, max_repeats, PACKET_WORDS)
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType.simpleString()
    totals = spark.createDataFrame([(s, n, target[s]) for s, n in size], f"_s {kind}, source_size long, target double")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(source_col).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(source_col, "_b", before.alias("_start"))
    per = totals.join(starts, F.col("_s").eqNullSafe(F.col(source_col))).select("_s", F.col("_b").alias("_c"), "source_size", "target", "_start")
    if len(size) * buckets <= BROADCAST_ROWS:
        per = F.broadcast(per)
    rows = rows.join(per, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")), "left")
    inside = W.partitionBy(source_col, "_b").orderBy("_k", id_col, "text_hash", "size")
    rows = rows.withColumn("before", F.col("_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.select(id_col, source_col, "size", "text_hash", "source_size", "target", "before", "_k", F.lit(budget).cast("long").alias("budget"), F.lit(late).alias("horizon"))


def mixed_sequence(plan: DataFrame, id_col: str = "doc_id", max_repeats: int = 3, slots: int | None = None, packet: int = PACKET_WORDS) -> DataFrame:
    """The mix from a plan: its columns, pass, finish (virtual), take (words), position (words of the mix before it).

    Rows are range-sorted by finish time: each slot of virtual time is ordered by itself, and sums per slot, of which
    there are `slots`, give where it starts. Words per slot are even by construction, whatever the sources. Services
    that begin after the horizon are beyond the budget, so they are not sorted.
    """
    slots = slots or pieces_of(plan, 512)
    rows = plan.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    rows = rows.withColumn("_from", F.col("pass") * F.col("source_size") + F.col("before"))
    rows = rows.filter(F.col("_from") < F.col("horizon") * F.col("target"))
    end = F.col("_from") + F.col("size")
    in_time = end <= F.col("target")
    last = F.least(end, F.ceil(F.col("horizon") * F.col("target"))) - 1
    rows = rows.withColumn("_part", F.explode(F.when(in_time, F.array("_from")).otherwise(F.sequence(F.col("_from"), F.greatest(last, F.col("_from")), F.lit(packet).cast("long")))))
    rows = rows.withColumn("take", F.when(in_time, F.col("size")).otherwise(F.least(F.lit(packet).cast("long"), end - F.col("_part"))))
    rows = rows.withColumn("finish", (F.col("_part") + F.col("take")) / F.col("target"))
    rows = rows.withColumn("_slot", F.least(F.floor(F.col("finish") / F.col("horizon") * slots), F.lit(slots - 1)).cast("int"))
    sums, starts, so_far = dict(rows.groupBy("_slot").agg(F.sum("take")).collect()), [], 0
    for slot in range(slots):
        starts.append(so_far)
        so_far += sums.get(slot, 0)
    starts = plan.sparkSession.createDataFrame(list(enumerate(starts)), "_at int, _begin long")
    rows = rows.join(F.broadcast(starts), F.col("_slot") == F.col("_at"))  # a row per slot
    inside = W.partitionBy("_slot").orderBy("finish", "_k", id_col, "text_hash", "_part").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.col("_begin") + F.coalesce(F.sum("take").over(inside), F.lit(0))).filter("position < budget")
    return rows.withColumn("take", F.least(F.col("take"), F.col("budget") - F.col("position"))).drop("_slot", "_at", "_begin", "_from", "_part")


def taken_words(plan: DataFrame, id_col: str = "doc_id", max_repeats: int = 3) -> DataFrame:
    """The plan with `taken`: the words of each document in the mix, over all passes; 0 for those that it leaves out.

    Rows with words differ in `before`, so each is a group of its own; rows without stay as they are.
    """
    names = plan.columns
    none = plan.withColumn("take", F.lit(0).cast("long"))
    both = none.filter("size > 0").unionByName(mixed_sequence(plan, id_col, max_repeats).select(*names, "take"))
    return both.groupBy(*names).agg(F.sum("take").alias("taken")).unionByName(none.filter("size = 0").withColumnRenamed("take", "taken"))


def sized(docs: DataFrame) -> DataFrame:
    """id, source, size in words and hash of the text of all documents, as a table: the only pass over the texts."""
    prepare(docs.sparkSession)
    return written(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The mix as documents, whole and repeated as often as they are served. A document at the cut is in if at least
    half of it is. Rows that are equal in id, source and text are one document here: all are in, or none, in a pass."""
    plan = written(mix_sources(sized(docs), weights=weights, max_repeats=max_repeats), "mix-plan")
    keys = ["doc_id", "source", "text_hash"]
    rows = plan.filter("size > 0").select(*keys, F.lit(-1).alias("pass"), F.col("size").alias("n"))
    rows = rows.unionByName(mixed_sequence(plan, max_repeats=max_repeats).select(*keys, "pass", F.col("take").alias("n")))
    words = [F.sum(F.when(F.col("pass") == i, F.col("n")).otherwise(0)) for i in range(-1, max_repeats)]
    copies = sum(((2 * w >= words[0]).cast("int") for w in words[1:]), F.lit(0))
    served = rows.groupBy(*keys).agg(copies.alias("__copies")).filter("__copies > 0").select(*(F.col(c).alias(f"__{c}") for c in keys), "__copies")
    # ids grow with the documents: they are shuffled, never broadcast, and the join builds on them, not on the texts
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # other columns may have any names
    same = F.col("doc.doc_id").eqNullSafe(F.col("__doc_id")) & F.col("doc.source").eqNullSafe(F.col("__source")) & (F.xxhash64("doc.text") == F.col("__text_hash"))
    rows = whole.join(served.hint("shuffle_hash"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
