"""Files in, files out, and streams."""
from __future__ import annotations

import gzip
import json
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from signalyard import catalog
from signalyard.operators import review, windows
from signalyard.sinks import files
from signalyard.sources import formats, tables
from signalyard.streaming import windows as stream


def test_formats_by_content_and_ending(spark):
    heads = [(b"\0" * 128 + b"DICM", "a.bin", "dicom"), (b"PAR1xx", "a", "parquet"), (b"\xffBIOSEMI ", "a", "bdf"), (b"0       X", "a.x", "edf"), (b"GDF 2", "a", "gdf"), (b"Brain Vision Data", "a.vhdr", "brainvision"), (b"rec 2 250 1000\nrec.dat 16 200 16\n", "rec.hea", "wfdb"), (b"hello", "a.csv", "csv"), (b"", "b", "unknown")]
    df = spark.createDataFrame(heads, "content binary, path string, want string")
    for r in df.select("want", formats.guess_format(F.col("content"), F.col("path")).alias("g")).collect():
        assert r["g"]["format"] == r["want"], r


def wfdb(folder, fmt=16, n=1000):
    x = np.stack([np.arange(n) % 200 - 100, (np.arange(n) * 3) % 500], 1).astype("<i4")
    size = {16: 2, 24: 3, 32: 4}[fmt]
    raw = x.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
    (folder / "r.dat").write_bytes(raw)
    (folder / "r.hea").write_text(f"r 2 250 {n}\nr.dat {fmt} 200(10)/mV 16 0 0 0 0 II\nr.dat {fmt} 100/uV 16 0 0 0 0 II\n")
    return x


@pytest.mark.parametrize("fmt", [16, 24, 32])
def test_wfdb_by_ranges(spark, tmp_path, fmt):
    x = wfdb(tmp_path, fmt)
    spark.dataSource.register(formats.Wfdb)
    rows = spark.read.format("wfdb").option("block", 300).load(str(tmp_path / "r.dat"))
    assert rows.rdd.getNumPartitions() == 4
    got = rows.filter("channel_index = 0").orderBy("n").collect()
    assert [r["x"] for r in got] == pytest.approx(((x[:, 0] - 10) / 200).tolist())
    names = formats.unique_names(rows.select("recording_id", "channel", "channel_index").distinct()).orderBy("channel_index").collect()
    assert [r["channel"] for r in names] == ["II", "II#2"]


@pytest.mark.parametrize("size", [2, 3])
def test_edf_and_bdf_by_records(spark, tmp_path, size):
    fast, slow = np.arange(40) * 5 - 100, np.arange(8) * -7
    records = [np.r_[fast[10 * k : 10 * k + 10], slow[2 * k : 2 * k + 2]] for k in range(4)]
    raw = b"".join(int(v).to_bytes(size, "little", signed=True) for r in records for v in r)
    pad = lambda *items: "".join(str(v).ljust(w) for v, w in items)
    top = pad(("0", 8), ("p", 80), ("r", 80), ("01.01.24", 8), ("00.00.00", 8), (256 * 3, 8), ("", 44), (4, 8), (2, 8), (2, 4))
    fields = [("EEG", "EDA"), ("", ""), ("uV", "uS"), (-100, 0), (100, 10), (-1000, 0), (1000, 100), ("", ""), (10, 2), ("", "")]
    signals = "".join(str(v).ljust(w) for values, (_, w) in zip(fields, formats.EDF_FIELDS, strict=True) for v in values)
    head = (top + signals).encode("latin-1")
    (tmp_path / "r.edf").write_bytes((b"\xff" if size == 3 else head[:1]) + head[1:] + raw)
    spark.dataSource.register(formats.Edf)
    rows = spark.read.format("edf").option("block", 3).load(str(tmp_path / "r.edf"))
    assert [r["x"] for r in rows.filter("channel = 'EEG'").orderBy("n").collect()] == pytest.approx((fast / 10).tolist())
    assert [r["x"] for r in rows.filter("channel = 'EDA'").orderBy("n").collect()] == pytest.approx((slow / 10).tolist())
    assert formats.open_recording(spark, str(tmp_path / "r.edf"), "edf").count() == 48


def test_samples_and_levels_round_trip(spark, tmp_path):
    from signalyard.operators import pyramid
    from signalyard.sources import store

    rows = spark.range(300).select(F.lit(1).alias("rec"), F.lit("II").alias("channel"), F.col("id").alias("n"), (F.col("id") / 2).alias("x"))
    store.write_samples(rows, str(tmp_path / "s"), block=100)
    assert sorted(r["n"] for r in store.read_samples(spark, str(tmp_path / "s"), 1, ["II"], 50, 60).collect()) == list(range(50, 60))
    store.write_levels(pyramid.pyramid(rows), str(tmp_path / "l"))
    assert store.read_level(spark, str(tmp_path / "l"), 64).count() == 5


def test_cards_that_break_the_contract_are_refused(tmp_path):
    from signalyard.functions import cards

    good = {"modality": "ecg", "L_m": 10, "fs_hz": 250, "class_order": ["Q0", "Q1"], "normalization": {"method": "zscore"}, "training_data_hash": "x", "model_version": "1"}
    heads = [{"name": "grade", "output_name": "q", "kind": "ordinal", "class_order": ["Q0", "Q1"]}, {"name": "art", "output_name": "a", "kind": "multilabel", "class_order": ["clean"], "threshold": 0.5}]
    path = tmp_path / "c.json"

    def load(**change):
        path.write_text(json.dumps({k: v for k, v in {**good, **change}.items() if v is not None}))
        return cards.load(path)

    assert load().heads[0].kind == "ordinal" and len(load(heads=heads).heads) == 2
    (tmp_path / "m.onnx").write_bytes(b"m")
    cards.verify_model(tmp_path / "m.onnx", load())
    with pytest.raises(cards.CardError):
        cards.verify_model(tmp_path / "m.onnx", load(onnx_sha256="0" * 64))
    with pytest.raises(cards.CardError):
        cards.verify_features(load(feature_preprocessing={"feature_names": ["a", "b"]}), ["b", "a"])
    for bad in ({"L_m": None}, {"L_m": 0}, {"class_order": []}, {"normalization": {"method": "x"}}, {"heads": []}, {"heads": [heads[1]]}, {"heads": [heads[0], heads[0]]}, {"heads": [{**heads[0], "activation": "sigmoid"}]}, {"heads": [heads[0], {**heads[1], "threshold": 2}]}):
        with pytest.raises(cards.CardError):
            load(**bad)


def test_degenerate_headers_are_refused():
    with pytest.raises(ValueError):
        formats.read_header("r 1 250 1\nr.dat 16")
    with pytest.raises(ValueError):
        formats.read_header("???")


def test_parquet_recordings(spark, tmp_path):
    spark.range(500).select((F.col("id") / 100).alias("time"), F.col("id").alias("n"), F.sin("id").alias("PLETH"), F.lit("x").alias("note")).write.parquet(str(tmp_path / "p"))
    long = formats.open_recording(spark, str(tmp_path / "p"), "parquet")
    assert {r["channel"] for r in long.select("channel").distinct().collect()} == {"PLETH"}
    part = tables.read_window(long, ["PLETH"], 10, 20)
    assert part.count() == 10 and "PushedFilters: [IsNotNull(n), GreaterThanOrEqual(n,10), LessThan(n,20)" in part._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        formats.open_recording(spark, "x", "fif")


def test_rates_that_make_no_sense_are_null(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in range(10)], "k int, t double").withColumn("t", F.when(F.col("k") == 1, F.col("t") * 0.01).otherwise(F.lit(5.0)))
    got = {r["k"]: (r["fs_hz"], r["unit"]) for r in formats.rate_from_time(rows, "k", "t").collect()}
    assert got[1] == (pytest.approx(100), "s") and got[2] == (None, None)


def test_rates_take_every_step(spark, tmp_path):
    """As the SQL has it, also where the first 4,096 samples have another rate, and at a step of 64 keys (3.90625 Hz)."""
    rows = spark.range(12_000).selectExpr("IF(id < 5000, id, 2 * id - 5000) / 100D AS t", "1 AS k")
    assert [tuple(r) for r in formats.rate_from_time(rows, "k", "t").collect()] == [(1, pytest.approx(50), "s")]
    assert [tuple(r) for r in formats.rate_from_time(rows, "k", "t", first=4096).collect()] == [(1, pytest.approx(100), "s")]
    part = [spark.range(9000).selectExpr(f"{a} AS p_size", f"{a} + IF(id < 4200, {b} * id, {c} * id - {(c - b) * 4200}) AS p_partkey") for a, b, c in ((1, 7, 9), (2, 30, 41), (3, 64, 64))]
    part[0].union(part[1]).union(part[2]).union(spark.sql("SELECT 5L, 8L")).write.parquet(str(tmp_path / "part.parquet"))
    want = duckdb.connect().execute(catalog.oracle_sql()["rate_from_time"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    got = catalog.queries()["rate_from_time"](spark, str(tmp_path)).select("k", "fs_hz", "unit").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


def records(spark):
    rows = [(1, 0, 0.0, 10.0, "Q3", 0.91, "", ["a"]), (1, 1, 10.0, 20.0, "Q1", 0.55, "", ["motion", "muscle"]), (1, 2, 20.0, 30.0, "Q0", 0.4, "Q1", [])]
    iv = spark.createDataFrame(rows, "rec long, run long, start_sec double, end_sec double, tier string, confidence double, model_tier string, artifacts array<string>")
    reviews = spark.createDataFrame([(1, 10_000, 20_000, "Q2", "=1+1")], "rec long, start_ms long, end_ms long, new_tier string, note string")
    return iv, review.interval_records(iv, reviews)


def test_records_and_text_sinks(spark, tmp_path):
    _, rec = records(spark)
    got = {r["start_sec"]: r for r in rec.collect()}
    assert got[10.0]["tier"] == "Q2" and got[10.0]["model_tier"] == "Q1" and got[10.0]["overridden"]
    assert got[20.0]["model_tier"] == "Q1" and got[20.0]["overridden"] and not got[0.0]["overridden"]
    for name, sink in files.SINKS.items():
        sink(rec, str(tmp_path / name))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.filter("note = \"'=1+1\"").count() == 1 and back.count() == 3
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).columns[:3] == ["onset", "duration", "trial_type"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect())) == sorted(map(tuple, rec.collect()))
    files.write_json(rec, str(tmp_path / "json"), {"model": "m"})
    doc = json.loads(spark.read.text(str(tmp_path / "json")).first()[0])
    assert doc["schema"] == "1.0" and doc["provenance"] == {"model": "m"} and [i["start_sec"] for i in doc["intervals"]] == [0, 10, 20]
    for _ in range(2):
        files.write_queue(rec, str(tmp_path / "queue"))
    assert spark.read.json(str(tmp_path / "queue")).count() == 6


def test_tables_have_the_fifteen_columns(spark, tmp_path):
    iv, _ = records(spark)
    reviews = spark.createDataFrame([(1, 10_000, 20_000, "Q2", "=1+1")], "rec long, start_ms long, end_ms long, new_tier string, note string")
    out = review.export_rows(iv, reviews, "II").drop("rec")
    files.write_csv(out, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == review.EXPORTED and len(review.EXPORTED) == 15
    got = {r["start_sec"]: r for r in back.collect()}
    assert got["10.0"]["artifacts"] == "motion;muscle" and got["10.0"]["note"] == "'=1+1" and got["10.0"]["tier"] == "Q2" and got["10.0"]["model_tier"] == "Q1"
    assert {k: r["overridden"] for k, r in got.items()} == {"0.0": "false", "10.0": "true", "20.0": "true"}
    assert {(r["recoverable"], r["rate_usable"], r["hr_bpm"], r["channel"]) for r in got.values()} == {("false", "false", "0.0", "II")}
    assert review.export_rows(iv.limit(0), None).count() == 0


def test_annotations_round_trip(spark, tmp_path):
    _, rec = records(spark)
    path = str(tmp_path / "r.atr")
    files.write_annotations(rec, path, 250)
    raw, at, i, got = (tmp_path / "r.atr").read_bytes(), 0, 0, []
    while (word := int.from_bytes(raw[i : i + 2], "little")) != 0:
        kind, value, i = word >> 10, word & 1023, i + 2
        if kind == files.SKIP:
            at += (int.from_bytes(raw[i : i + 2], "little") << 16) + int.from_bytes(raw[i + 2 : i + 4], "little")
            i += 4
        elif kind == files.NOTE:
            at += value
            got.append([at, None, ""])
        elif kind == files.SUB:
            got[-1][1] = value
        elif kind == files.AUX:
            got[-1][2], i = raw[i : i + value].decode(), i + value + value % 2
    assert got == [[0, 3, "Q3"], [2500, 2, "Q2 =1+1"], [5000, 0, "Q0"]]


@pytest.mark.parametrize("piece", [7, 33, 400])
def test_stream_equals_batch(spark, tmp_path, piece):
    rng = np.random.default_rng(0)
    rows = [(r, n, float(rng.normal())) for r, size in enumerate((31, 32, 100, 117)) for n in range(size)]
    last = {r: max(n for q, n, _ in rows if q == r) for r in range(4)}
    schema = "rec long, n long, x double, last boolean"
    for k in range(0, 117, piece):
        part = [(r, n, x, n == last[r]) for r, n, x in rows if k <= n < k + piece]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = stream.stream_stats(feed, 32, 16).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted((r["rec"], r["start_n"], round(r["m"], 9), round(r["sd"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = windows.window_stats(spark.createDataFrame(rows, "rec long, n long, x double"), 32, 16).collect()
    assert got == sorted((r["rec"], r["start_n"], round(r["m"], 9), round(r["sd"], 9)) for r in batch)


def test_context_gates_reviews(spark):
    rows = spark.createDataFrame([("r", "II", 0, "m1", 1, 0, 0.0, 1.0, "Q1", "Q2", None), ("r", "II", 0, "m1", 1, 1, 0.0004, 1.0, "Q1", None, "ok"), ("r", "II", 0, "m2", 1, 2, 0.0, 1.0, "Q1", "Q0", None)], "recording string, channel string, channel_index int, model_version string, revision int, seq int, start_sec double, end_sec double, orig string, new_tier string, note string")
    merged = review.upsert_reviews(rows)
    assert merged.count() == 2
    here = spark.createDataFrame([("r", "II", 0, "m1", 1)], "recording string, channel string, channel_index int, model_version string, revision int")
    only = review.in_context(merged, here).collect()
    assert [(r["new_tier"], r["note"], r["orig"]) for r in only] == [("Q2", "ok", "Q1")]


def test_streamed_envelope_and_late_rows(spark, tmp_path):
    for k in range(3):
        spark.range(50 * k, 50 * k + 50).select(F.lit(1).cast("long").alias("rec"), F.col("id").alias("n"), F.sin("id").alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("rec long, n long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.stream_envelope(feed, 20).writeStream.outputMode("complete").format("memory").queryName("envelopes").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["bucket"]: (r["lo"], r["hi"]) for r in spark.table("envelopes").collect()}
    x = np.sin(np.arange(150))
    assert len(got) == 8 and all(v == (pytest.approx(x[20 * b : 20 * b + 20].min()), pytest.approx(x[20 * b : 20 * b + 20].max())) for b, v in got.items())
    rows = [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:40:00", "a"), ("2024-01-01 03:00:00", "b")]
    for k, part in enumerate((rows[:2], rows[2:], [("2024-01-01 00:10:00", "a"), ("2024-01-01 09:00:00", "b")])):
        spark.createDataFrame(part, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"e/{k}"))
    for k in range(3):
        spark.read.parquet(str(tmp_path / f"e/{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        feed = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
        q = stream.late_counts(feed).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(str(r["window"]["start"]), r["event_type"], r["n"]) for r in out} >= {("2024-01-01 00:00:00", "a", 2)}


def zarr(folder, name, x, chunk, packing=None, attributes=None):
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b)}[packing]
    at = folder / name
    at.mkdir(parents=True)
    at.joinpath(".zarray").write_text(json.dumps({"zarr_format": 2, "shape": list(x.shape), "chunks": [chunk] * x.ndim, "dtype": x.dtype.str, "compressor": packing and {"id": packing}, "fill_value": 0, "filters": None, "order": "C"}))
    if attributes:
        at.joinpath(".zattrs").write_text(json.dumps(attributes))
    x = x.ravel()
    for i in range(0, len(x), chunk):
        part = np.zeros(chunk, x.dtype)
        part[: len(x[i : i + chunk])] = x[i : i + chunk]
        (at / str(i // chunk)).write_bytes(pack(part.tobytes()))


def test_zarr_by_chunks(spark, tmp_path):
    store, want = tmp_path / "rec.zarr", {}
    for k, packing in enumerate((None, "zlib", "gzip", "zstd")):
        want[f"c{k}"] = np.sin(np.arange(250 + 10 * k) / (k + 2)).astype("<f4")
        zarr(store, f"c{k}", want[f"c{k}"], 64, packing, {"fs_hz": 100 + k, "unit": "mV"})
    (store / "c1" / "1").unlink()  # a chunk that is not there holds the fill value
    want["c1"][64:128] = 0
    assert [c["fs"] for c in formats.read_zarr_header(store)] == [100, 101, 102, 103]
    rows = formats.open_recording(spark, str(store), "zarr")
    for name, x in want.items():
        got = rows.filter(F.col("channel") == name).orderBy("n").collect()
        assert [r["n"] for r in got] == list(range(len(x))) and [r["x"] for r in got] == pytest.approx(x.tolist())
    part = spark.read.format("zarr").option("start", 60).option("end", 130).option("channels", "c0,c3").option("block", 1).load(str(store))
    assert part.rdd.getNumPartitions() == 6
    assert {(r["channel"], r["n"]) for r in part.collect()} == {(c, n) for c in ("c0", "c3") for n in range(60, 130)}


@pytest.mark.parametrize("shape,attributes", [((4, 8), {"fs": 100}), ((8,), {}), ((8,), {"fs": "fast"}), ((8,), {"sfreq": 250000}), ((8,), {"fs": "nan"})])
def test_zarr_that_is_no_recording_is_refused(tmp_path, shape, attributes):
    zarr(tmp_path, "c", np.zeros(shape, "<f4"), 8, None, attributes)
    with pytest.raises(ValueError):
        formats.read_zarr_header(tmp_path)


def test_zarr_rate_of_the_channel_before_that_of_the_group():
    assert formats.attribute_rate("c", {"fs": 8}, {"fs_hz": 250}) == 8 and formats.attribute_rate("c", {}, {"sfreq": 64}) == 64
