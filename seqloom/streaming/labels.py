"""Label sequences as streams: runs that have ended, and counts by event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "key string, start timestamp, end timestamp, label string, n bigint"
STATE = "start timestamp, end timestamp, label string, n bigint"


def window_counts(stream: DataFrame, label: str = "event_type", ts: str = "ts", width: str = "10 minutes", hop: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, label, n) of sliding windows over event time; rows later than `late` are left out."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width, hop).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("w.start", "w.end", "label", "n")


def closed_runs(stream: DataFrame, key: str = "user_id", label: str = "event_type", ts: str = "ts", idle: str = "30 minutes") -> DataFrame:
    """(key, start, end, label, n): runs of equal labels, sent when another label follows or when the watermark passes the key's last row by idle.
    Rows of a batch are ordered by time; the state of a key is one open run."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            out.append((*run,))
        else:
            rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
            for t, x in zip(rows["ts"], rows["label"]):
                if run is not None and run[2] == x:
                    run = (run[0], max(run[1], t), x, run[3] + 1)
                else:
                    if run is not None:
                        out.append((*run,))
                    run = (t, t, x, 1)
            state.update(run)
            if state.getCurrentWatermarkMs() > 0:
                state.setTimeoutTimestamp(max(int(run[1].timestamp() * 1000), state.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame([(str(name[0]), *r) for r in out], columns=["key", "start", "end", "label", "n"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(label).alias("label")).withWatermark("ts", idle)
    return rows.groupBy("key").applyInPandasWithState(step, RUN, STATE, "append", "EventTimeTimeout")
