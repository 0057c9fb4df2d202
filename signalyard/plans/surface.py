"""Queries over sources, streams, and the relational surface that the engine leaves to Spark."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels as L
from ..operators import explain
from ..sinks import files
from ..sources import formats
from ..sources.tables import table
from ..runtime import new_path
from ..streaming import windows as stream
from .sql import INTERVALS, LENGTH, STATS, STEP
from .views import intervals, register, rounded, samples

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = "round({0}, 6) AS {0}".format


@query("streamed_window_stats", f"WITH {STATS} SELECT rec, start_n, {R('m')}, {R('sd')}, {R('lo')}, {R('hi')} FROM stats")
def streamed_window_stats(spark, sf):
    """The windows of the events as a stream of files, each a stretch of every recording."""
    base = new_path(spark, "stream")
    rows = samples(spark, sf)
    rows = rows.withColumn("last", F.lead("n").over(W.partitionBy("rec").orderBy("n")).isNull()).withColumn("part", F.floor(F.col("n") / 25))
    rows.repartition(1, "part").sortWithinPartitions("part", "rec", "n").write.partitionBy("part").parquet(f"{base}/in")
    parts = sorted(r[0] for r in spark.read.parquet(f"{base}/in").select("part").distinct().collect())
    schema = "rec long, n long, x double, last boolean"
    for k, p in enumerate(parts):  # files are taken in order of their times
        spark.read.schema(schema).parquet(f"{base}/in/part={p}").coalesce(1).write.mode("append").parquet(f"{base}/feed")
        q = stream.stream_stats(spark.readStream.schema(schema).parquet(f"{base}/feed"), LENGTH, STEP).writeStream
        q = q.option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{base}/out")
        q.awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"))


@query("json_reports", f"WITH {INTERVALS} SELECT rec, count(*) AS n, round(sum(end_sec - start_sec), 4) AS total FROM intervals GROUP BY 1")
def json_reports(spark, sf):
    """Reports written as JSON and read back."""
    rows = intervals(spark, sf).select("rec", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"), "tier")
    reports = files.report(rows, {"model": "rule", "model_version": "1"})
    got = reports.select(F.from_json("value", "schema string, rec long, intervals array<struct<start_sec:double,end_sec:double,tier:string>>").alias("j"))
    each = got.select("j.rec", F.explode("j.intervals").alias("i"))
    return rounded(each.groupBy("rec").agg(F.count("*").alias("n"), F.sum(F.col("i.end_sec") - F.col("i.start_sec")).alias("total")), 4)


CHANNELS = [(1, 0, "II", "mV", 250.0), (1, 1, "II", "mV", 250.0), (2, 0, "PLETH", "NU", 64.0), (3, 0, "Fp1", "uV", 256.0), (3, 1, "EOG", "uV", 256.0), (4, 0, "GSR", "uS", 8.0), (5, 0, "x", "", 60.0)]
CHANNELS_SQL = "(VALUES " + ", ".join(f"({a}, {b}, '{c}', '{d}', {e}::DOUBLE)" for a, b, c, d, e in CHANNELS) + ") AS c(recording_id, channel_index, channel, unit, fs)"


def channels(spark):
    return spark.createDataFrame(CHANNELS, "recording_id int, channel_index int, channel string, unit string, fs double")


@query("unique_channel_names", f"SELECT recording_id, channel_index, CASE WHEN row_number() OVER w > 1 THEN channel || '#' || row_number() OVER w ELSE channel END AS channel FROM {CHANNELS_SQL} WINDOW w AS (PARTITION BY recording_id, channel ORDER BY channel_index)")
def unique_channel_names(spark, sf):
    return formats.unique_names(channels(spark)).select("recording_id", "channel_index", "channel")


@query("unit_modality", f"SELECT recording_id, channel_index, CASE lower(unit) WHEN 'mv' THEN 'ecg' WHEN 'nu' THEN 'ppg' WHEN 'uv' THEN 'eeg' WHEN 'us' THEN 'eda' END AS modality FROM {CHANNELS_SQL}")
def unit_modality(spark, sf):
    return channels(spark).select("recording_id", "channel_index", L.unit_modality(F.col("unit")).alias("modality"))


@query("modality_vote")
def modality_vote(spark, sf):
    return rounded(channels(spark).select("recording_id", "channel_index", L.modality_votes(F.col("unit"), F.col("channel"), F.col("fs")).alias("v")).select("recording_id", "channel_index", "v.*"))


@query("preferred_channels", f"SELECT recording_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN regexp_matches(lower(channel), '{'|'.join(L.PREFERRED['eeg'])}') THEN 0 ELSE 1 END, channel_index) AS r FROM {CHANNELS_SQL}) WHERE r = 1")
def preferred_channels(spark, sf):
    return L.preferred_channel(channels(spark), "eeg")


@query("guard_banners", f"SELECT recording_id AS rec, bool_or(fs < 100) AS warning, coalesce(string_agg(channel, '; ' ORDER BY channel_index) FILTER (WHERE fs < 100), '') AS banner FROM {CHANNELS_SQL} GROUP BY 1")
def guard_banners(spark, sf):
    rows = channels(spark).select(F.col("recording_id").alias("rec"), F.col("channel_index").alias("ord"), (F.col("fs") < 100).alias("fired"), F.col("channel").alias("reason"))
    return explain.guard_banner(rows)


@query("rate_from_time", "WITH s AS (SELECT p_size AS k, p_partkey * (CASE p_size % 3 WHEN 0 THEN 0.004 WHEN 1 THEN 4.0 ELSE 4000.0 END) AS t FROM part), d AS (SELECT k, lead(t) OVER (PARTITION BY k ORDER BY t) - t AS d FROM s), m AS (SELECT k, quantile_cont(d, 0.5) AS d FROM d WHERE d IS NOT NULL GROUP BY 1) SELECT k, round(CASE WHEN 1 / d BETWEEN 0.5 AND 20000 THEN 1 / d WHEN 1e3 / d BETWEEN 0.5 AND 20000 THEN 1e3 / d WHEN 1e6 / d BETWEEN 0.5 AND 20000 THEN 1e6 / d ELSE 1e9 / d END, 4) AS fs_hz, CASE WHEN 1 / d BETWEEN 0.5 AND 20000 THEN 's' WHEN 1e3 / d BETWEEN 0.5 AND 20000 THEN 'ms' WHEN 1e6 / d BETWEEN 0.5 AND 20000 THEN 'us' ELSE 'ns' END AS unit FROM m")
def rate_from_time(spark, sf):
    exact = lambda x: F.lit(x).cast("decimal(7, 3)")
    scale = F.when(F.col("p_size") % 3 == 0, exact("0.004")).when(F.col("p_size") % 3 == 1, exact("4")).otherwise(exact("4000"))
    rows = table(spark, sf, "part").select(F.col("p_size").alias("k"), (F.col("p_partkey") * scale).alias("t"))
    return rounded(formats.rate_from_time(rows, "k", "t"), 4)


@query("synthetic_recordings")
def synthetic_recordings(spark, sf):
    rows = formats.synthetic(spark, "eda", 60, records=3)
    return rounded(rows.groupBy("rec").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")))


@query("resampled")
def resampled(spark, sf):
    rows = formats.resampled(samples(spark, sf), 50.0, 20.0)
    return rounded(rows.groupBy("rec").agg(F.count("*").alias("n"), F.avg("x").alias("m")), 4)


@query("tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), 4)


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"), "n")


@query("exact_percentiles", "SELECT user_id, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def exact_percentiles(spark, sf):
    p = lambda q, n: F.percentile("value", F.lit(q)).alias(n)
    return rounded(table(spark, sf, "events").groupBy("user_id").agg(p(0.25, "q1"), p(0.5, "q2"), p(0.99, "q99")))


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def revenue_by_nation(spark, sf):
    t = lambda n: table(spark, sf, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rows.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.countDistinct("o_orderkey").alias("orders")), 2)


@query("segment_rollup", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def segment_rollup(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("status_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def status_cube(spark, sf):
    return rounded(table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")), 2)


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("users_of_both", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def users_of_both(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'signup'").select("user_id"))


@query("last_value_before", "SELECT a.event_id, (SELECT max_by(b.value, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS v FROM events a WHERE a.event_type = 'purchase'")
def last_value_before(spark, sf):
    """As-of lookup: the value of the user's last view at or before a purchase, by one ordered pass."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("v", seen).filter("event_type = 'purchase'").select("event_id", "v")


@query("json_fields", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark, sf):
    return table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("speaker_runs", "WITH m AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) SELECT conv_id, min(role) AS role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, run")
def speaker_runs(spark, sf):
    from ..operators.segments import with_runs

    rows = with_runs(table(spark, sf, "conversations"), "conv_id", "turn", ("role",))
    return rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.count("*").alias("n")).drop("run")


#: SQL text over the views, the same in both engines.
TEXT = "SELECT i.tier, count(DISTINCT i.rec) AS recordings, count(*) AS n, round(avg(i.confidence), 6) AS confidence FROM intervals i JOIN (SELECT rec, count(*) AS len FROM samples GROUP BY rec) s ON s.rec = i.rec WHERE i.end_sec <= s.len GROUP BY i.tier"


@query("sql_over_views", f"WITH {INTERVALS} {TEXT}")
def sql_over_views(spark, sf):
    register(spark, sf)
    return spark.sql(TEXT)
