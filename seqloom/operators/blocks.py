"""Rows of a key in blocks of bounded size, each met by all of the key's rows of a smaller table, as matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """The vectors of a column as the rows of a matrix of doubles."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks]
    return np.concatenate(flat).astype(np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def alike(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with keys of the same types: an int and a bigint of one value go to different partitions, where a cogroup doesn't meet them."""
    if [left.schema[c].dataType for c in keys] == [right.schema[c].dataType for c in keys]:
        return left, right
    kinds = left.select(*keys).union(right.select(*keys)).schema
    return tuple(d.withColumns({c: F.col(c).cast(kinds[c].dataType) for c in keys}) for d in (left, right))


def met(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema,
    id: str = "frame_id",
    block_rows: int = 2048,
) -> DataFrame:
    """work(block, others) for each block of left's rows of a key and right's rows of that key, neither of them empty.

    Keys with a null, and keys that only one side has, are left out. A key of any size on the left is spread over blocks;
    right's rows of one key must fit in a task, as the centroids or centers of a phone do, and are sent once a block.
    """
    left, right = alike(left, right, keys)
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__blocks"))
    blocks = sizes.join(right.select(*keys).distinct(), keys)
    own = left.join(blocks, keys).withColumn("__block", F.pmod(F.xxhash64(id), F.col("__blocks")).cast("int")).drop("__blocks")
    other = right.join(blocks, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a.drop_columns(["__block"]), b.drop_columns(["__block"]))

    by = [*keys, "__block"]
    own, other = (d.select(*(F.col(f"`{c}`").alias(c) for c in d.columns)) for d in (own, other))  # new columns, for both may come from one table
    return own.groupBy(*by).cogroup(other.groupBy(*by)).applyInArrow(run, schema)
