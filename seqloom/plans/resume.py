"""A step in buckets, which goes on where it stopped: its rows are dealt by key into buckets, and each bucket's result counts once the manifest has it.

The input is first written by bucket, so that a bucket reads its own files. Buckets are worked off some at a time; their results replace
what a broken run left of them (dynamic partition overwrite), and then they enter the manifest. A run that is started again works off the buckets
that the manifest hasn't got. What was written without entering it is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.sources.corpora import exists


def done(spark: SparkSession, path: str) -> list[int]:
    """The buckets of the manifest."""
    manifest = f"{path.rstrip('/')}/manifest"
    return sorted(r[0] for r in spark.read.parquet(manifest).select("bucket").distinct().collect()) if exists(spark, f"{manifest}/_SUCCESS") else []


def result(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the buckets that are done."""
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/rows").filter(F.col("bucket").isin(done(spark, root))).drop("bucket")


def in_buckets(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, buckets: int = 64, at_once: int = 8) -> DataFrame:
    """work over df, bucket by bucket. Rows of one key are in one bucket, so work may group by it. A key of many rows makes a large bucket, which is
    as many tasks as it has files."""
    spark, root = df.sparkSession, path.rstrip("/")
    if not exists(spark, f"{root}/input/_SUCCESS"):
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/input")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{root}/input")
    left = [b for b in range(buckets) if b not in set(done(spark, root))]
    for i in range(0, len(left), at_once):
        own = left[i : i + at_once]
        # work sees a bucket's rows without its number, so each bucket's result gets it back
        parts = [work(rows.filter(F.col("bucket") == b).drop("bucket")).withColumn("bucket", F.lit(b)) for b in own]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/rows")
        spark.createDataFrame([(b,) for b in own], "bucket int").coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return result(spark, root)
