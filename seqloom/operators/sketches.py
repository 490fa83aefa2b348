"""Directions of variance without a dims x dims matrix on the driver: merged triangular factors, whole or truncated.

A set of rows is summed up by its number, its mean and a factor R with R'R the scatter around the mean. Two such facts merge: R stacks both factors and
the difference of the means, by sqrt(n m / (n + m)), and is made triangular again. Tasks merge their batches, groups of at most FAN tasks' facts
merge on the executors, round by round, and the last merge gives the leading directions. What comes to the driver is k directions.

Whole factors (`rows` None) are exact: a tall and skinny QR. Truncated ones keep `rows` directions of each merge, as an incremental PCA does:
they take rows x dims numbers, at the price of an error that depends on the order of the rows where directions of nearly equal variance compete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.linalg import _matrix
from seqloom.storage import stored

#: Facts that are merged at once.
FAN = 8
FACTS = "task int, n bigint, mean binary, factor binary"


def _thinned(r: np.ndarray, rows: int | None) -> np.ndarray:
    """A factor of the same scatter with dims rows at most, or its leading part."""
    if rows is not None:
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        return s[:rows, None] * vt[:rows]
    return np.linalg.qr(r, mode="r") if len(r) > r.shape[1] else r


def merged(facts: list[tuple[int, np.ndarray, np.ndarray]], rows: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """The facts (n, mean, factor) of all rows together."""
    n, mean, factor = facts[0]
    stack = [factor]
    for m, other, r in facts[1:]:
        if not m:
            continue
        if not n:
            n, mean, stack = m, other, [r]
            continue
        stack += [r, np.sqrt(n * m / (n + m)) * (mean - other)[None, :]]
        n, mean = n + m, mean + (other - mean) * (m / (n + m))
    return n, mean, _thinned(np.concatenate(stack), rows)


def of_batch(x: np.ndarray, rows: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(0)
    return len(x), mean, _thinned(x - mean, rows)


def _table(task: int, fact: tuple[int, np.ndarray, np.ndarray]) -> list[pa.Array]:
    n, mean, factor = fact
    return [pa.array([task], pa.int32()), pa.array([n], pa.int64()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (mean, factor))]


def _facts(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for r in t.sort_by("task").to_pylist():
        mean = np.frombuffer(r["mean"])
        out.append((r["n"], mean, np.frombuffer(r["factor"]).reshape(-1, len(mean))))
    return out


def facts(df: DataFrame, vector: str = "feature", rows: int | None = None, batch: int | None = None) -> DataFrame:
    """A row of facts a task. batch: rows that are merged at once; the batches that Spark makes if not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now = None
        for b in batches:
            x = _matrix(b.column(0))
            for i in range(0, len(x), batch or max(len(x), 1)):
                new = of_batch(x[i : i + (batch or len(x))], rows)
                now = new if now is None else merged([now, new], rows)
        if now is not None:
            yield pa.RecordBatch.from_arrays(_table(TaskContext.get().partitionId(), now), ["task", "n", "mean", "factor"])

    return df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(run, FACTS)


def _all(found: DataFrame, rows: int | None, name: str) -> DataFrame:
    """All facts as one, by rounds on the executors: a group merges FAN of them."""

    def merge(t: pa.Table) -> pa.Table:
        task = min(t.column("task").to_pylist()) // FAN
        return pa.table(_table(task, merged(_facts(t), rows)), names=["task", "n", "mean", "factor"])

    found = stored(found, name)
    while (tasks := found.agg(F.max("task")).first()[0]) not in (None, 0):
        found = stored(found.groupBy(F.floor(F.col("task") / FAN).alias("group")).applyInArrow(merge, FACTS), f"{name}-{tasks}")
    return found


def leading(df: DataFrame, k: int, vector: str = "feature", rows: int | None = None, batch: int | None = None) -> dict[str, np.ndarray]:
    """The k directions of most variance around the mean, as `linalg.pca` gives them: mean, components, variance, ratio, n. k * dims numbers leave
    the executors. ratio: of the whole variance, or, with `rows`, of that of the directions that were kept."""
    one = _all(facts(df, vector, rows, batch), rows, "factors")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, mean, factor in _facts(pa.Table.from_batches([b])):
                fine = np.isfinite(factor).all()
                _, s, vt = np.linalg.svd(factor if fine else np.zeros_like(factor), full_matrices=False)
                size = max(0, min(k, len(s), n - 1, len(mean)))
                columns = [pa.array([n], pa.int64()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (mean, s[:size], vt[:size], [np.sum(s**2) if fine else np.nan]))]
                yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "s", "v", "total"])

    found = one.mapInArrow(last, "n bigint, mean binary, s binary, v binary, total binary").collect()
    if not found:
        return {"mean": np.zeros(0), "components": np.zeros((0, 0)), "variance": np.zeros(0), "ratio": np.zeros(0), "n": 0, "unit": False}
    n, (mean, s, v, total) = found[0]["n"], (np.frombuffer(found[0][c]) for c in ("mean", "s", "v", "total"))
    if np.isnan(total[0]):
        raise np.linalg.LinAlgError("vectors that aren't finite")
    v = v.reshape(-1, len(mean))
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)]) if len(v) else np.ones(0)
    return {"mean": mean, "components": v * signs[:, None], "variance": s**2 / max(n - 1, 1), "ratio": s**2 / max(float(total[0]), 1e-300), "n": n, "unit": False}


def incremental_pca(df: DataFrame, k: int, vector: str = "feature", spare: int = 10, batch: int = 1000, unit: bool = False) -> dict[str, np.ndarray]:
    """PCA in batches of bounded size, each merged into k + spare directions. unit: of vectors scaled to unit length, as `linalg.transformed` then does."""
    from seqloom.functions import vec

    df = df.withColumn(vector, vec.normalized(F.col(vector))) if unit else df
    return leading(df, k, vector, k + spare, batch) | {"unit": unit}
