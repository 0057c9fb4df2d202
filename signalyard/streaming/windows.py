"""Windows of a stream: the same as those of the whole recording.

State per recording is what no full window has used yet and the last window's worth of samples, so the end-anchored
window can be made when the end of the recording is marked.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rec long, start_n long, m double, sd double, lo double, hi double"
STATE = "first long, x array<double>, next long"


def stream_stats(samples: DataFrame, length: int, step: int) -> DataFrame:
    """Statistics of the windows of a stream (rec, n, x, last): `last` marks the final sample of a recording. Samples of
    a recording must come in order over micro-batches; within one they may come in any."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values("n")
        first, held, start = (int(state.get[0]), np.array(state.get[1], float), int(state.get[2])) if state.exists else (0, np.zeros(0), 0)
        x = np.r_[held, new["x"].to_numpy(float)]
        end, rows = first + len(x), []

        def window(at: int) -> None:
            w = x[at - first : at - first + length]
            rows.append((key[0], at, w.mean(), w.std(), w.min(), w.max()))

        while start + length <= end:
            window(start)
            start += step
        if bool(new["last"].any()):
            if end >= length and (end - length) % step:
                window(end - length)
            state.remove()
        else:
            keep = max(first, min(start, end - length))
            state.update((keep, x[keep - first :].tolist(), start))
        yield pd.DataFrame(rows, columns=["rec", "start_n", "m", "sd", "lo", "hi"])

    return samples.groupBy("rec").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_envelope(samples: DataFrame, per_bucket: int) -> DataFrame:
    """Least and greatest value of each bucket of a stream; the bucket grid is that of the whole recording."""
    from pyspark.sql import functions as F

    return samples.groupBy("rec", F.floor(F.col("n") / per_bucket).alias("bucket")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def late_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window with a watermark: later rows are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
