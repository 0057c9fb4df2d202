"""Sinks for interval records. Spark's commit protocol makes each of them atomic."""
from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import safe_cell

#: Annotation code of a note and of a skip in MIT annotation files.
NOTE, SKIP, AUX, SUB = 22, 59, 63, 61


def _flat(records: DataFrame) -> DataFrame:
    lists = [c for c, kind in records.dtypes if kind.startswith("array")]
    return records.select(*(F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in records.columns))


def write_csv(records: DataFrame, path: str) -> None:
    rows = _flat(records)
    rows = rows.withColumn("note", safe_cell(F.col("note"))) if "note" in rows.columns else rows
    rows.write.option("header", True).csv(path)


def write_tsv(records: DataFrame, path: str) -> None:
    """Events as BIDS has them: onset, duration, trial_type and the rest."""
    rows = _flat(records).withColumn("duration", F.round(F.col("end_sec") - F.col("start_sec"), 4))
    rows = rows.withColumnRenamed("start_sec", "onset").withColumnRenamed("tier", "trial_type").drop("end_sec")
    first = ["onset", "duration", "trial_type"]
    rows.select(*first, *(c for c in rows.columns if c not in first)).write.option("header", True).option("sep", "\t").csv(path)


def report(records: DataFrame, provenance: dict[str, str], key: str = "rec") -> DataFrame:
    """(key, value): a JSON report per recording, its intervals in order, with provenance."""
    names = [c for c in records.columns if c not in (key, "channel")]
    rows = F.array_sort(F.collect_list(F.struct("start_sec", *(c for c in names if c != "start_sec"))))
    told = F.struct(*(F.lit(v).alias(k) for k, v in sorted(provenance.items())))
    doc = F.struct(F.lit("1.0").alias("schema"), told.alias("provenance"), F.col(key), F.col("intervals"))
    return records.groupBy(key).agg(rows.alias("intervals")).select(key, F.to_json(doc).alias("value"))


def write_json(records: DataFrame, path: str, provenance: dict[str, str], key: str = "rec") -> None:
    report(records, provenance, key).select("value").write.text(path)


def write_parquet(records: DataFrame, path: str) -> None:
    records.write.parquet(path)


def write_queue(rows: DataFrame, path: str) -> None:
    """Reviewed rows for training, appended as JSON lines."""
    rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_annotations(records: DataFrame, path: str, fs: float) -> None:
    """A WFDB annotation file of one recording: a note at each start, its subtype the tier, its text `tier note`.
    Intervals are streamed to the driver in order, one partition at a time."""
    out, at = bytearray(), 0
    for r in records.orderBy("start_sec").toLocalIterator():
        n = int(np.round(r["start_sec"] * fs))
        gap, at = n - at, n
        if gap > 1023:
            out += (SKIP << 10).to_bytes(2, "little") + (gap >> 16).to_bytes(2, "little") + (gap & 0xFFFF).to_bytes(2, "little")
            gap = 0
        text = f"{r['tier']} {r['note'] if 'note' in r else ''}".strip().encode()
        out += (NOTE << 10 | gap).to_bytes(2, "little") + (SUB << 10 | int(r["tier"][1])).to_bytes(2, "little")
        out += (AUX << 10 | len(text)).to_bytes(2, "little") + text + b"\0" * (len(text) % 2)
    part = Path(path + ".part")
    part.write_bytes(bytes(out) + b"\0\0")
    part.replace(path)


SINKS = {"csv": write_csv, "tsv": write_tsv, "parquet": write_parquet}
