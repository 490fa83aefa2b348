"""A codebook learnt batch by batch, whose state is a small table: mini-batch k-means over segments of frames, or over a stream.

Each batch assigns its rows to the nearest centers and moves each center towards the mean of its rows by rows / (all rows that it has had), so a center is
the mean of all rows that were ever assigned to it. A center that had no row yet takes the mean as it is. The state (centers, how many rows each has had,
the last batch) is written as one file a batch; a run that stopped goes on behind the last batch that was written, and a batch that comes
again is skipped. Batches that are small against `RUN_ROWS` are learnt in runs: a job a run, in which one task takes the run's batches one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.cluster import _nearest
from seqloom.operators.linalg import _matrix, _summed
from seqloom.sources.corpora import exists

#: Rows that a run of small batches has at most.
RUN_ROWS = 100_000


@dataclass(frozen=True)
class State:
    """centers (k x dims), rows (k): how many rows each center has had; batch: the last one's number."""

    centers: np.ndarray
    rows: np.ndarray = field(default=None)
    batch: int = -1

    def __post_init__(self):
        if self.rows is None:
            object.__setattr__(self, "rows", np.zeros(len(self.centers), dtype=np.int64))


def begun(batch: DataFrame, k: int, vector: str = "feature", id: str = "frame_id") -> State:
    """Centers at the vectors of the k least ids of a batch; of fewer, as many."""
    first = batch.filter(F.col(vector).isNotNull()).orderBy(id).limit(k).select(F.col(vector).cast("array<double>")).collect()
    return State(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), -1))


def partial_fit(state: State, batch: DataFrame, number: int | None = None, vector: str = "feature") -> State:
    """The state after one batch. Sums by center are made on the executors; k * (dims + 1) numbers come to the driver. A batch whose number isn't behind the
    state's changes nothing."""
    number = state.batch + 1 if number is None else number
    if number <= state.batch:
        return state
    centers = state.centers
    total = _summed(batch.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")), lambda b: _sums(_matrix(b.column(0)), centers), centers.size + len(centers))
    return _moved(state, total, number)


def _sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """How many rows each center is the nearest of, and behind them the sums of those rows."""
    k, dims = centers.shape
    code = _nearest(x, centers)
    sums = np.zeros((k, dims))
    np.add.at(sums, code, x)
    return np.concatenate([np.bincount(code, minlength=k).astype(np.float64), sums.ravel()])


def _moved(state: State, total: np.ndarray, number: int) -> State:
    """The state after a batch with these numbers and sums."""
    centers, k = state.centers, len(state.centers)
    n, sums = total[:k], total[k:].reshape(centers.shape)
    rows = state.rows + n.astype(np.int64)
    rate = (n / np.maximum(rows, 1))[:, None]
    moved = centers + rate * (sums / np.maximum(n, 1)[:, None] - centers)
    return State(np.where(n[:, None] > 0, moved, centers), rows, number)


def segments(frames: DataFrame, ranges: Iterable[tuple[int, int]], batch_rows: int = 100_000, id: str = "frame_id") -> list[DataFrame]:
    """The batches of (start, length) ranges of ids, each in pieces of batch_rows ids, in the order given. Each is a filter that reaches the scan."""
    out = []
    for start, length in ranges:
        for at in range(start, start + length, batch_rows):
            out.append(frames.filter((F.col(id) >= at) & (F.col(id) < min(at + batch_rows, start + length))))
    return out


def fitted_in_runs(frames: DataFrame, total: int, batch_rows: int, k: int, path: str, vector: str = "feature", id: str = "frame_id", run_rows: int = RUN_ROWS) -> State:
    """The state after the batches of batch_rows ids each from 0 to total, as `fitted` gives it for their `segments`. A job takes as many whole batches as run_rows ids
    hold, one at least, in one task; the state is saved behind each run, with the number of its last batch."""
    state = load(frames.sparkSession, path)
    together = max(1, run_rows // batch_rows)
    at = (state.batch + 1) * batch_rows if state else 0
    while at < total:
        end = min(at + together * batch_rows, total)
        if state is None:
            state = begun(frames.filter((F.col(id) >= 0) & (F.col(id) < min(batch_rows, total))), k, vector, id)
        run = frames.filter((F.col(id) >= at) & (F.col(id) < end))
        state = learnt(state, run, batch_rows, -(-end // batch_rows) - 1, vector, id) if together > 1 else partial_fit(state, run, at // batch_rows, vector)
        save(frames.sparkSession, state, path)
        at = end
    return state


def learnt(state: State, run: DataFrame, batch_rows: int, last: int, vector: str = "feature", id: str = "frame_id") -> State:
    """The state after a run of batches of batch_rows ids each, the last of which has the number `last`, taken in order by one task."""

    def learn(t: pa.Table) -> pa.Table:
        x, number, now = _matrix(t.column("v").combine_chunks()), t.column("b").to_numpy(), state
        order = np.argsort(t.column("i").to_numpy(), kind="stable")
        x, number = x[order], number[order]
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(number)]):
            now = _moved(now, _sums(x[a:z], now.centers), int(number[a]))
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in (now.centers, now.rows)], names=["centers", "rows"])

    i = F.col(id).cast("bigint")
    rows = run.filter(F.col(vector).isNotNull()).select(i.alias("i"), F.floor(i / batch_rows).cast("bigint").alias("b"), F.col(vector).cast("array<double>").alias("v"))
    found = rows.groupBy(F.lit(0).alias("run")).applyInArrow(learn, "centers binary, rows binary").collect()  # k * (dims + 1) numbers
    if not found:
        return replace(state, batch=last)
    return State(np.frombuffer(found[0]["centers"]).reshape(state.centers.shape), np.frombuffer(found[0]["rows"], np.int64), last)


def even_segments(total: int, most: int | None, n: int) -> list[tuple[int, int]]:
    """n segments spaced evenly over `total` rows, `most` rows together; one with all rows if that isn't less."""
    if most is None or most >= total:
        return [(0, total)]
    length = most // n
    return [(int(s), length) for s in np.linspace(0, total - length, n, dtype=int)]


def save(spark: SparkSession, state: State, path: str) -> None:
    """Writes the state as path/<batch>, complete once its _SUCCESS is there."""
    rows = [(i, [float(v) for v in c], int(n)) for i, (c, n) in enumerate(zip(state.centers, state.rows))]
    spark.createDataFrame(rows, "center_no int, center array<double>, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{state.batch}")


def load(spark: SparkSession, path: str) -> State | None:
    """The last state that was written to its end, or None."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [p.getPath().getName() for p in store.listStatus(root)] if store.exists(root) else []
    done = [int(n) for n in names if n.isdigit() and exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")]
    if not done:
        return None
    found = spark.read.parquet(f"{path.rstrip('/')}/{max(done)}").orderBy("center_no").collect()
    return State(np.array([r["center"] for r in found]), np.array([r["n"] for r in found], dtype=np.int64), max(done))


def fitted(batches: list[DataFrame], k: int, path: str, vector: str = "feature", id: str = "frame_id") -> State:
    """The state after all batches; those that the state below path has had are not read again."""
    state = load(batches[0].sparkSession, path)
    for number, batch in enumerate(batches):
        if state is None:
            state = replace(begun(batch, k, vector, id), batch=-1)
        if number > state.batch:
            state = partial_fit(state, batch, number, vector)
            save(batch.sparkSession, state, path)
    return state


def streamed(stream: DataFrame, k: int, path: str, checkpoint: str, vector: str = "feature", id: str = "frame_id", **trigger):
    """The started query that learns from each micro-batch of a stream. A micro-batch that is tried again counts once. Until a batch has rows, there
    is no state."""

    def learn(batch: DataFrame, number: int) -> None:
        state = load(batch.sparkSession, path)
        if state is None:
            state = begun(batch, k, vector, id)
            if not len(state.centers):
                return
        if number > state.batch:
            save(batch.sparkSession, partial_fit(state, batch, number, vector), path)

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
