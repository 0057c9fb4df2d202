"""Document fingerprints: a threshold-scaled sketch.

Every shingle of five words is hashed; the sketch keeps all hashes below a fixed fraction of the hash range, so the
sketch of a union is the union of the sketches, and the share of one sketch in another estimates containment however
unequal the documents are. The least hash of all stands beside them: a short text that keeps none is compared by it, and
the least of a union is the least of the leasts.

Null or empty text (no word): the empty sketch, of likeness 1 to another empty one and 0 to any other. Fewer than five
words: one shingle of all. Very long texts: their sketch is a fraction of their shingles. Null id: before all others, in
order of the text's hash. Ties: rows of one id go by the text's hash, and rows of one id and text are one document, with
one next. Repeated rows: each has a row, all alike. Other columns are not read. Empty table: empty result. All of it is
DataFrame expressions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_count, range_buckets, written

#: Hashes are 32 bits; those below 2^32 * FRACTION are kept.
FRACTION = 0.25


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, width: int = 5, fraction: float = FRACTION) -> Column:
    """(kept, least) of a text: the retained hashes, ascending, and the least of all, null without a word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h) - F.lit(width - 1)
        long = F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(1))), lambda x, i: _top(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width)))))
        return F.when(n >= 1, long).when(F.size(h) > 0, F.array(_top(F.xxhash64(F.concat_ws(",", h))))).otherwise(F.array().cast("array<bigint>"))

    def retained(all_: Column) -> Column:
        low = F.filter(all_, lambda x: x < F.lit(int(2**32 * fraction)))
        return F.struct(F.array_sort(F.array_distinct(low)).alias("kept"), F.array_min(all_).alias("least"))

    return _let(_let(hashes, shingles), retained)


def _top(h: Column) -> Column:
    """The upper half of a 64-bit hash, as a number from 0 to 2^32 - 1."""
    return F.shiftrightunsigned(h, 32)


def written_out(s: Column) -> Column:
    """A sketch as text: eight hex digits a hash; of a sketch that keeps none, a slash and its least."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    only = F.when((F.size(s["kept"]) == 0) & s["least"].isNotNull(), F.concat(F.lit("/"), digits(s["least"])))
    return F.coalesce(only, F.concat_ws("", F.transform(s["kept"], digits)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller document in the other, from their sketches."""
    none = F.array().cast("array<bigint>")

    def told(s: Column) -> Column:
        return F.when(F.size(s["kept"]) > 0, s["kept"]).when(s["least"].isNotNull(), F.array(s["least"])).otherwise(none)

    def compare(two: Column) -> Column:
        x, y = two["x"], two["y"]
        least = F.least(F.size(x), F.size(y))
        both_empty = (F.size(x) == 0) & (F.size(y) == 0)
        return F.when(both_empty, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least).cast("double")

    return _let(F.struct(told(a).alias("x"), told(b).alias("y")), compare)


def merged(sketches: DataFrame, by: str, column: str = "sketch") -> DataFrame:
    """Sketches of unions of documents: one for each value of `by`, from sketches alone."""
    each = sketches.select(by, F.explode_outer(f"{column}.kept").alias("h"), F.col(f"{column}.least").alias("l"))
    kept = F.array_sort(F.collect_set("h")).alias("kept")
    return each.groupBy(by).agg(kept, F.min("l").alias("least")).select(by, F.struct("kept", "least").alias(column))


def next_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(id, h, n, next_id, next_h) of the distinct (id, h) of rows (id, h, n), in order of id, null first, and h; the first
    follows the last. Only these numbers are ordered, by ranges; the first row of each range goes to the driver."""
    one = written(docs.groupBy("id", "h").agg(F.max("n").alias("n"), F.count("*").alias("rows")), "documents-once")
    count = buckets or bucket_count(docs.sparkSession)
    bucket, _ = range_buckets(one, "id", count, (F.col("h") / F.lit(2.0**64) + 0.5))
    one = one.withColumn("_b", bucket)
    order = (F.col("id").asc_nulls_first(), "h")
    place = F.struct(F.col("id").isNotNull().alias("some"), "id", "h")
    firsts = one.groupBy("_b").agg(F.min(place).alias("f")).orderBy("_b").collect()
    kind = docs.schema["id"].dataType.simpleString()
    after = [(r["_b"], firsts[(i + 1) % len(firsts)]["f"]["id"], firsts[(i + 1) % len(firsts)]["f"]["h"]) for i, r in enumerate(firsts)]
    after = docs.sparkSession.createDataFrame(after, f"_c int, first_id {kind}, first_h long")
    inside = F.lead(F.struct("id", "h")).over(W.partitionBy("_b").orderBy(*order))
    rows = one.withColumn("next", inside).join(F.broadcast(after), F.col("_b") == F.col("_c"))  # a row per range
    here = F.col("next").isNotNull()
    return rows.select("id", "h", "n", "rows", F.when(here, F.col("next.id")).otherwise(F.col("first_id")).alias("next_id"), F.when(here, F.col("next.h")).otherwise(F.col("first_h")).alias("next_h"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, text, sketch, head, next_sketch): each document with as many first code points of the next in ascending key
    (the first after the last) as a quarter of its own, and the next one's sketch.

    Which document is the next is found on ids alone. Texts are then shuffled once, by id and hash: a document is asked
    for its head, and the head goes to who asked.
    """
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    plan = written(next_documents(texts.select("id", "h", F.length("text").alias("n")), buckets), "next-documents")
    asks = plan.select(F.col("next_id").alias("_id"), F.col("next_h").alias("_h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    heads = texts.join(asks, same).select("to_id", "to_h", F.substr("text", F.lit(1), F.col("k")).alias("head"), sketch(F.col("text")).alias("next_sketch"))
    if not plan.filter("rows > 1").isEmpty():
        heads = heads.dropDuplicates(["to_id", "to_h"])
    mine = F.col("id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h"))
    rows = texts.join(heads, mine).select(F.col("id").alias(key), "text", "head", "next_sketch")
    return rows.withColumn("sketch", sketch(F.col("text")))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many first code points of the following one, or all it has."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - k), F.substr(following, F.lit(1), k))
