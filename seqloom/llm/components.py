"""Connected components of an edge table, by contraction within tasks and pointer jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import freed, scratch, stored

EDGE = "a bigint, b bigint"
#: Edges that a task holds besides the stars made so far.
HELD = 1 << 20


def components(edges: DataFrame, name: str = "components", most_rounds: int = 50) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that can be reached.

    A task makes stars of its edges: each node points to the least that its own edges reach. Stars are dealt by the node that points, so a node has at
    most one pointer from each task that saw it, however many edges it has, and all its pointers meet in one task, which makes stars anew. Then each
    pointer is moved on to where its target points, by a join, so a target of many nodes is spread as any skewed join is. Rounds are written, so no
    lineage grows. Loops, repeated edges and edges with a null are left out; nodes without other edges don't appear.
    """
    with scratch(edges.sparkSession):
        return stored(_reached(edges, name, most_rounds), name, outlives=True)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that isn't the least of those it reaches, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while True:
        ends = up[at]
        at = at[:, apart := ends[0] != ends[1]]
        if not apart.any():
            return nodes[up != np.arange(len(nodes))], nodes[up[up != np.arange(len(nodes))]]
        np.minimum.at(up, ends[:, apart].max(0), ends[:, apart].min(0))
        while ((further := up[up]) != up).any():
            up = further


def _contracted(edges: DataFrame) -> DataFrame:
    """The stars that each task makes of its edges."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size > HELD:
                a, b = stars(*(np.concatenate(x) for x in zip((a, b), *held)))
                held, size = [], 0
        if held:
            a, b = stars(*(np.concatenate(x) for x in zip((a, b), *held)))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (a, b)], ["a", "b"])

    return edges.mapInArrow(freed(contract), EDGE)


def _reached(edges: DataFrame, name: str, most_rounds: int) -> DataFrame:
    now = edges.filter("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    for turn in range(most_rounds):
        # stars come before the first deal only: later a node has at most one pointer from each task of the round before
        now = stored(_contracted((now if turn else _contracted(now)).repartition("a")), f"{name}-stars{turn}")
        # done when each node points to one and that points to none
        ends = now.select(F.col("a").alias("x"), "b", F.lit(0).alias("top")).unionByName(now.select(F.col("b").alias("x"), F.lit(None).cast("bigint").alias("b"), F.lit(1).alias("top")))
        if not ends.groupBy("x").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.max("top").alias("top")).filter("lo < hi or lo is not null and top = 1").limit(1).count():
            return now.unionByName(now.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("component"))
        onward = now.groupBy("a").agg(F.min("b").alias("next")).withColumnRenamed("a", "b")
        now = now.join(onward, "b", "left").select("a", F.coalesce("next", "b").alias("b"))
    raise RuntimeError("no end after the most rounds")
