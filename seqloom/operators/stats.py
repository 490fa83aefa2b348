"""Grouped statistics: centroids, confusion entropy, percentile filters, diversity, tallies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators import blocks


def centroids(df: DataFrame, keys: list[str], dims: int, vector: str = "feature", least: int = 1) -> DataFrame:
    """(keys, n, centroid) of groups with at least so many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), vec.mean_vector(F.col(vector), dims).alias("centroid")).filter(F.col("n") >= least)


def moments(df: DataFrame, keys: list[str], dims: int, vector: str = "feature") -> DataFrame:
    """(keys, n, mean, variance): sample variance, zeros for fewer than two rows."""
    v = F.col(vector)
    some = df.groupBy(*keys).agg(F.count("*").alias("n"), vec.mean_vector(v, dims).alias("mean"), F.array(*(F.var_samp(v[i]) for i in range(dims))).alias("variance"))
    return some.withColumn("variance", F.when(F.col("n") < 2, F.transform("mean", lambda x: F.lit(0.0))).otherwise(F.col("variance")))


def speaker_centroids(df: DataFrame, dims: int, least_rows: int = 3, least_speakers: int = 3) -> DataFrame:
    """(phone, speaker, n, centroid) where a speaker has enough rows of the phone and the phone enough such speakers."""
    some = centroids(df, ["phone", "speaker"], dims, least=least_rows)
    enough = some.groupBy("phone").agg(F.count("*").alias("s")).filter(F.col("s") >= least_speakers).select("phone")
    return some.join(enough, "phone", "left_semi")


def confusion_entropy(df: DataFrame, speaker_means: DataFrame, temperature: float = 10.0, id: str = "frame_id") -> DataFrame:
    """(id, phone, entropy, n): of the softmax of -distance / temperature to the centroids of the phone's speakers, divided by ln(n); 0 for one
    speaker. A block of frames meets its phone's centroids in one matrix product."""
    kinds = dict(df.dtypes)

    def work(rows: pa.Table, means: pa.Table) -> pa.Table:
        means = means.sort_by("speaker")
        z = -np.sqrt(blocks.squared_distances(blocks.matrix(rows, "feature"), blocks.matrix(means, "centroid"))) / temperature
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        n = means.num_rows
        entropy = -(p * np.log(p + 1e-9)).sum(1) / np.log(n) if n > 1 else np.zeros(rows.num_rows)
        return rows.select([id, "phone"]).append_column("entropy", pa.array(entropy)).append_column("n", pa.array(np.full(rows.num_rows, n, np.int64)))

    return blocks.met(df.select(id, "phone", "feature"), speaker_means.select("phone", "speaker", "centroid"), ["phone"], work, f"`{id}` {kinds[id]}, phone {kinds['phone']}, entropy double, n bigint", id)


def cluster_entropy(df: DataFrame, dims: int, cluster: str = "cluster", temperature: float = 5.0) -> DataFrame:
    """(cluster, entropy): the mean confusion entropy of a cluster's rows among its own speakers; 0 with one speaker."""
    keyed = df.withColumn("phone", F.col(cluster))
    found = confusion_entropy(keyed, centroids(keyed, ["phone", "speaker"], dims), temperature)
    return found.groupBy(F.col("phone").alias(cluster)).agg(F.avg("entropy").alias("entropy"))


def interpolated(df: DataFrame, group: list[str], value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """(group, edge): the exact interpolated percentile of each group's values; null and NaN are left out.

    Approximate percentiles bound a narrow band around the place; only what is in the band is counted by value and
    sorted, so no group's values meet in one task. Groups of up to `accuracy` rows are a band of their own.
    """
    some = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("__v"))
    n, off = F.count("*"), 3 / accuracy
    near = lambda s, end: F.when(n <= accuracy, end("__v")).otherwise(F.percentile_approx("__v", F.lit(min(1.0, max(0.0, s))), accuracy))
    bounds = some.groupBy(*group).agg(n.alias("__n"), near(share - off, F.min).alias("__lo"), near(share + off, F.max).alias("__hi"))
    rows = some.join(bounds, group) if group else some.crossJoin(F.broadcast(bounds))
    # what is below the band has no value and sorts in front of it
    counted = rows.filter("__v <= __hi").groupBy(*group, F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    ends = counted.withColumn("__z", F.sum("__c").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = F.lit(share) * (F.col("__n") - 1)
    holds = lambda place: (F.col("__z") - F.col("__c") <= place) & (place < F.col("__z"))
    low = F.floor(x)
    places = ends.filter("__v is not null").groupBy(*group).agg(
        F.max(F.when(holds(low), F.col("__v"))).alias("__a"), F.max(F.when(holds(F.least(low + 1, F.col("__n") - 1)), F.col("__v"))).alias("__b"), F.first("__n").alias("__n")
    )
    return places.select(*group, (F.col("__a") + (F.col("__b") - F.col("__a")) * (x - low)).alias("edge"))


def over_percentile(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """Rows at or above their group's percentile of value (interpolated); a null or NaN value is left out first."""
    some = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return some.join(interpolated(some, group, value, share).withColumnRenamed("edge", "__edge"), group).filter(F.col(value) >= F.col("__edge")).drop("__edge")


def top_clusters(clusters: DataFrame, value: str = "entropy", top_share: float = 0.5) -> DataFrame:
    """Clusters not below the percentile 1 - top_share of all."""
    edge = clusters.agg(F.percentile(value, 1 - top_share).alias("__edge"))
    return clusters.join(F.broadcast(edge), F.col(value) >= F.col("__edge")).drop("__edge")


def diverse(df: DataFrame, cluster: list[str], speaker: str = "speaker", least: int = 3) -> DataFrame:
    """Rows of clusters that at least so many distinct speakers are in."""
    good = df.groupBy(*cluster).agg(F.count_distinct(speaker).alias("s")).filter(F.col("s") >= least).select(*cluster)
    return df.join(good, cluster, "left_semi")


def nearest_to_center(df: DataFrame, cluster: list[str], n: int, distance: str = "distance", id: str = "frame_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*cluster).orderBy(F.round(distance, 6), id))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def grouped_counts(df: DataFrame) -> DataFrame:
    """(phone, gender, n, level): counts for (phone, gender) and for phone alone in one pass."""
    out = df.groupingSets([["phone", "gender"], ["phone"]], "phone", "gender").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return out


def frequency(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most frequent values, of equal counts the smaller first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(column, "n", (100 * F.col("n") / F.col("__all")).alias("percent"))


def weighted_mean(df: DataFrame, keys: list[str], dims: int, vector: str, weight: str) -> DataFrame:
    """(keys, vector): zeros where the weights sum to nothing."""
    v, w = F.col(vector), F.sum(weight)
    return df.groupBy(*keys).agg(F.array(*(F.when(w > 0, F.sum(F.col(weight) * v[i]) / w).otherwise(F.lit(0.0)) for i in range(dims))).alias(vector))


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, r): Pearson, 0 where either deviation is at most 1e-6."""
    still = (F.stddev_pop(x) <= 1e-6) | (F.stddev_pop(y) <= 1e-6)
    return df.groupBy(*keys).agg(F.when(still | (F.count("*") < 2), F.lit(0.0)).otherwise(F.corr(x, y)).alias("r"))


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Pools one behind the other with the part's name and new row numbers' offsets (offset + old row_id)."""
    out, shift = None, 0
    for name, p in parts.items():
        moved = p.withColumn("part", F.lit(name)).withColumn("row_id", F.col("row_id") + F.lit(shift))
        out, shift = moved if out is None else out.unionByName(moved), shift + p.count()
    return out


def outcome(df: DataFrame, ok: Column) -> DataFrame:
    """(status, n)."""
    return df.groupBy(F.when(ok, "success").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))


def attempted(df: DataFrame, work, schema: str, columns: list[str]) -> DataFrame:
    """work(row values) of each row as result, with error instead where it raised; the job goes on. An Arrow-batched function."""
    @F.pandas_udf(f"struct<result:{schema},error:string>")
    def run(*parts: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(*parts):
            try:
                out.append((work(*values), None))
            except Exception as e:  # noqa: BLE001  reported in the row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"])

    return df.withColumn("__o", run(*columns)).select(*df.columns, "__o.result", "__o.error")
