"""Edits of intervals, reviews, and the rows that sinks write."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONTEXT = ("recording", "channel", "channel_index", "model_version", "revision")
LEAST_SEC = 0.1


def move_boundary(intervals: DataFrame, moves: DataFrame) -> DataFrame:
    """Intervals with the boundary after (rec, run) moved to `to`, at least 0.1 s from the far ends of both neighbours."""
    w = W.partitionBy("rec").orderBy("run")
    rows = intervals.join(moves, ["rec", "run"], "left")
    low, high = F.col("start_sec") + LEAST_SEC, F.lead("end_sec").over(w) - LEAST_SEC
    at = F.when(high.isNotNull(), F.greatest(low, F.least(high, F.col("to"))))
    rows = rows.withColumn("_at", F.when(F.col("to").isNotNull(), at))
    start = F.coalesce(F.lag("_at").over(w), F.col("start_sec"))
    return rows.withColumn("start_sec", start).withColumn("end_sec", F.coalesce("_at", "end_sec")).drop("_at", "to")


def split(intervals: DataFrame, at: DataFrame) -> DataFrame:
    """Intervals cut at all times (rec, t) that lie inside by at least 0.1 s; part numbers the pieces. Of times nearer than
    0.1 s to a cut before them, none cuts again."""
    s, e = F.col("start_sec"), F.col("end_sec")
    times = at.groupBy("rec").agg(F.array_sort(F.collect_set("t")).alias("_t"))
    inside = F.filter(F.coalesce("_t", F.array().cast("array<double>")), lambda t: (t > s + LEAST_SEC) & (t < e - LEAST_SEC))
    apart = F.aggregate(inside, F.array(s), lambda cuts, t: F.when(t > F.element_at(cuts, -1) + LEAST_SEC, F.concat(cuts, F.array(t))).otherwise(cuts))
    rows = intervals.join(times, "rec", "left").withColumn("_cuts", F.concat(apart, F.array(e)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda k: F.struct(F.get("_cuts", k).alias("start_sec"), F.get("_cuts", k + 1).alias("end_sec"), k.alias("part")))
    return rows.withColumn("_p", F.explode(pieces)).drop("start_sec", "end_sec", "_t", "_cuts").select("*", "_p.*").drop("_p")


def merge_next(intervals: DataFrame, chosen: DataFrame) -> DataFrame:
    """Intervals where (rec, run) in `chosen` takes in the next one; neighbours that are all chosen become one. The longest
    gives tier and confidence, of equals the leftmost; artifacts, if there are any, are united in order."""
    w = W.partitionBy("rec").orderBy("run")
    rows = intervals.join(chosen.select("rec", "run").distinct().withColumn("_m", F.lit(1)), ["rec", "run"], "left")
    rows = rows.withColumn("_new", F.when(F.lag("_m").over(w) == 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    d = F.col("end_sec") - F.col("start_sec")
    best = F.max_by(F.struct("tier", "confidence"), F.struct(d, F.negate("run"))).alias("b")
    aggs, names = [F.min("run").alias("run"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), best], ["rec", "run", "start_sec", "end_sec", "b.*"]
    if "artifacts" in intervals.columns:
        tags = F.array_sort(F.collect_list(F.struct("run", "artifacts")))
        aggs.append(F.array_distinct(F.flatten(F.transform(tags, lambda t: t["artifacts"]))).alias("artifacts"))
        names.append("artifacts")
    return rows.groupBy("rec", "_g").agg(*aggs).select(*names)


def reclassify(intervals: DataFrame, chosen: DataFrame) -> DataFrame:
    """Intervals with a new tier for (rec, run, new_tier); model_tier keeps the first original."""
    rows = intervals.join(chosen, ["rec", "run"], "left")
    model = F.when(F.col("new_tier").isNull(), F.col("model_tier")).otherwise(F.coalesce(F.nullif("model_tier", F.lit("")), F.col("tier")))
    return rows.withColumn("model_tier", model).withColumn("tier", F.coalesce("new_tier", "tier")).drop("new_tier")


def span_key(start: Column, end: Column) -> tuple[Column, Column]:
    """Milliseconds, halves to even: what identifies a reviewed interval."""
    return F.bround(start * 1000, 0).cast("long"), F.bround(end * 1000, 0).cast("long")


def upsert_reviews(actions: DataFrame) -> DataFrame:
    """One review per context and span from a log of actions (seq, start_sec, end_sec, orig, new_tier, note): the first
    original, and the last new tier and note that were given."""
    a, b = span_key(F.col("start_sec"), F.col("end_sec"))
    keys = [c for c in CONTEXT if c in actions.columns]
    rows = actions.withColumn("start_ms", a).withColumn("end_ms", b)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy(*keys, "start_ms", "end_ms").agg(F.min_by("orig", "seq").alias("orig"), last("new_tier"), last("note"))


def in_context(reviews: DataFrame, context: DataFrame) -> DataFrame:
    """Reviews of the present context only: a change of any part drops them."""
    return reviews.join(context, [c for c in CONTEXT if c in reviews.columns], "left_semi")


def never_reviewed(intervals: DataFrame, reviews: DataFrame) -> DataFrame:
    a, b = span_key(F.col("start_sec"), F.col("end_sec"))
    return intervals.withColumn("start_ms", a).withColumn("end_ms", b).join(reviews, ["rec", "start_ms", "end_ms"], "left_anti").drop("start_ms", "end_ms")


def safe_cell(note: Column) -> Column:
    """A note that no spreadsheet takes for a formula."""
    return F.when(F.substring(note, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), note)).otherwise(note)


def interval_records(intervals: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The rows that every sink writes: the tier after review, the model's own, whether it was overridden, rounded numbers."""
    a, b = span_key(F.col("start_sec"), F.col("end_sec"))
    rows = intervals.withColumn("start_ms", a).withColumn("end_ms", b)
    if reviews is None:
        rows = rows.withColumn("new_tier", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    else:
        rows = rows.join(reviews.select("rec", "start_ms", "end_ms", "new_tier", "note"), ["rec", "start_ms", "end_ms"], "left")
    changed = F.col("new_tier").isNotNull() & (F.col("new_tier") != F.col("tier"))
    shown = F.coalesce(F.nullif("model_tier", F.lit("")), F.col("tier"))
    return rows.select(
        "rec", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"), F.coalesce("new_tier", "tier").alias("tier"), shown.alias("model_tier"),
        F.round("confidence", 4).alias("confidence"), (changed | (F.coalesce("model_tier", F.lit("")) != "")).alias("overridden"), F.coalesce("note", F.lit("")).alias("note"),
    )


#: The columns that tables of intervals have, in this order.
EXPORTED = ("start_sec", "end_sec", "tier", "model_tier", "confidence", "artifacts", "overridden", "note", "recoverable", "recovered_tier", "uncertainty", "rate_usable", "hr_bpm", "conformal_set", "channel")


def export_rows(intervals: DataFrame, reviews: DataFrame | None = None, channel: str = "", key: str = "rec") -> DataFrame:
    """(key, the 15 exported columns): an interval's tier is that of its review, if it has one; model_tier keeps the
    model's; an interval is overridden by a review with a tier, or if it was reclassified. What an interval does not carry is false, empty or 0. `channel` names the graded signal of intervals that
    have no column of that name."""
    no_tags, no, text = F.array().cast("array<string>"), F.lit(False), F.lit("")
    absent = {"model_tier": text, "artifacts": no_tags, "recoverable": no, "recovered_tier": text, "uncertainty": F.lit(0.0), "rate_usable": no, "hr_bpm": F.lit(0.0), "conformal_set": no_tags, "channel": F.lit(channel)}
    rows = intervals.withColumns({c: F.coalesce(F.col(c), v) if c in intervals.columns else v for c, v in absent.items()})
    if reviews is None:
        rows = rows.withColumns({"new_tier": F.lit(None).cast("string"), "note": text})
    else:
        a, b = span_key(F.col("start_sec"), F.col("end_sec"))
        given = reviews.select(key, "start_ms", "end_ms", "new_tier", "note")
        rows = rows.withColumns({"start_ms": a, "end_ms": b}).join(given, [key, "start_ms", "end_ms"], "left")
    corrected = F.nullif("new_tier", text)
    shown = {
        "overridden": corrected.isNotNull() | ((F.col("model_tier") != "") & (F.col("model_tier") != F.col("tier"))), "model_tier": F.coalesce(F.nullif("model_tier", text), F.col("tier")), "tier": F.coalesce(corrected, F.col("tier")),
        "note": F.coalesce("note", text), "uncertainty": F.round("uncertainty", 4), "hr_bpm": F.round("hr_bpm", 1),
    }
    return rows.withColumns(shown).select(key, *EXPORTED)
