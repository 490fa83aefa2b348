"""Pools as bucketed tables, so that a join on the bucket's key moves the small side only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(frames: DataFrame, name: str, keys: list[str], buckets: int = 200, path: str | None = None) -> DataFrame:
    """The frames as a table in `buckets` buckets by a hash of the keys, sorted by them in each file; one file a bucket, for rows are dealt so before.

    Joins and aggregations on the keys then need no exchange of the table. Choose `buckets` so that one, held by a task, fits; a key of very
    many rows makes one large bucket, so keys should be ids, or hold a block number.
    """
    out = frames.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    (out.option("path", path) if path else out).saveAsTable(name)
    return frames.sparkSession.table(name)


def load(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def exchanges(df: DataFrame, table: str) -> int:
    """How many exchanges the plan has between the scans of a table and the first join above each."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = 0
    for i, line in enumerate(plan):
        if "Scan" not in line or table not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        for above in reversed(plan[:i]):
            at = len(above) - len(above.lstrip(" :+-"))
            if at >= depth:
                continue
            depth = at
            if "Join" in above:
                break
            found += "Exchange" in above
    return found
