"""Frames: one row per frame with its key, place, vector and labels. Writing, reading, joining and checking them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqloom.sources import npy
from seqloom.sources.corpora import exists
from seqloom.storage import positioned, stored

UTTERANCE = "utt_id string, speaker_id string, gender string, emotion string, dataset string, duration_sec double, num_frames int, h5_start_idx bigint, h5_end_idx bigint"
FRAME = "frame_id bigint, utt_id string, t int, feature array<float>"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as frames: 20 to an utterance, 7 speakers, 2 genders, the label as phone."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    return e.select(i.alias("frame_id"), F.floor(i / 20).alias("utt"), (i % 20).cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("feature"), F.col("label").cast("int").alias("phone"), (i % 7).cast("int").alias("speaker"), (i % 2).cast("int").alias("gender"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as label sequences: a user's events in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("utt"), "ts", "event_id", F.col("event_type").alias("phone"), "value")


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Appends rows; by: columns that become folders, which reads then prune."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def append(df: DataFrame, path: str, order: list[str], attributes: dict | None = None) -> tuple[int, int]:
    """Appends rows, numbered in their order behind those that are there, as frame_id; returns their range [start, end). attributes: kept beside them,
    see attributes_of."""
    spark = df.sparkSession
    start = (spark.read.parquet(path).agg(F.max("frame_id")).first()[0] + 1) if exists(spark, path + "/_SUCCESS") else 0
    rows = stored(positioned(df.drop("frame_id").withColumn("__all", F.lit(0)), "__all", order).drop("__all"), "appended")
    end = start + rows.count()
    rows.withColumn("frame_id", F.col("pos") + F.lit(start)).drop("pos").write.mode("append").parquet(path)
    if attributes:
        spark.createDataFrame([(json.dumps(attributes),)], "value string").coalesce(1).write.mode("append").text(path.rstrip("/") + ".attributes")
    return start, end


def attributes_of(spark: SparkSession, path: str) -> dict:
    """The attributes of all appends to a path, later ones over earlier ones of the same name within a file's order."""
    beside = path.rstrip("/") + ".attributes"
    if not exists(spark, beside):
        return {}
    lines = spark.read.text(beside).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")).orderBy("t", "p").collect()
    return {k: v for r in lines for k, v in json.loads(r["value"]).items()}


def iterate(df: DataFrame, batch: int, key: str = "frame_id") -> Iterator[list[Row]]:
    """Lists of `batch` rows in the order of key. Rows come to the driver a partition at a time."""
    held: list[Row] = []
    for row in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == batch:
            yield held
            held = []
    if held:
        yield held


def read_range(df: DataFrame, start: int, end: int, key: str = "frame_id") -> DataFrame:
    return df.filter((F.col(key) >= start) & (F.col(key) < end))


def read_indices(df: DataFrame, ids: DataFrame, key: str = "frame_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All parts, their frame ids shifted so that they don't meet."""
    shift, out = 0, None
    for p in parts:
        moved = p.withColumn("frame_id", F.col("frame_id") + F.lit(shift))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        shift += (p.agg(F.max("frame_id")).first()[0] or -1) + 1
    return out


def verified(df: DataFrame, column: str = "feature") -> DataFrame:
    """One row: rows, dims found (least, most), rows with a NaN, rows with an infinity."""
    odd = lambda test: F.count_if(F.coalesce(F.exists(column, test), F.lit(False)))
    return df.agg(F.count("*").alias("n_rows"), F.min(F.size(column)).alias("least_dims"), F.max(F.size(column)).alias("most_dims"), odd(F.isnan).alias("n_nan"), odd(lambda x: F.abs(x) == float("inf")).alias("n_inf"))


def with_utterances(df: DataFrame, utterances: DataFrame) -> DataFrame:
    """Frames with the attributes of the utterance whose [h5_start_idx, h5_end_idx) holds them.

    Utterance ranges don't overlap, so each frame is matched through the bucket of its id: ranges are spread over the
    buckets they touch and joined by equality, not by comparing all.
    """
    width = 1024
    ranges = utterances.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("h5_start_idx") / width), F.floor((F.greatest("h5_end_idx", F.col("h5_start_idx") + 1) - 1) / width))))
    inside = (F.col("frame_id") >= F.col("h5_start_idx")) & (F.col("frame_id") < F.col("h5_end_idx"))
    return df.withColumn("bucket", F.floor(F.col("frame_id") / width)).join(ranges, "bucket").filter(inside).drop("bucket")


def gathered(df: DataFrame, segments: DataFrame) -> DataFrame:
    """The frames of the segments (segment, start, end), with segment; a frame in several of them comes once for each."""
    ranges = segments.select("segment", F.col("start").alias("h5_start_idx"), F.col("end").alias("h5_end_idx")).filter("h5_end_idx > h5_start_idx")
    return with_utterances(df, ranges).drop("h5_start_idx", "h5_end_idx")


def aligned(labels: str, n_frames: str, pad: int = 0):
    """A label array cut or padded on the right with the silence label to the number of frames."""
    short = F.greatest(F.col(n_frames) - F.size(labels), F.lit(0))
    return F.concat(F.slice(labels, 1, F.col(n_frames)), F.array_repeat(F.lit(pad), short))


def pool_problems(pool: DataFrame, clusters: DataFrame | None = None, required=("frame_id", "feature", "phone")) -> DataFrame:
    """(severity, problem) of a target pool: missing or null required columns are errors, missing clusters a warning."""
    spark = pool.sparkSession
    missing = [("error", f"missing column {c}") for c in required if c not in pool.columns] + ([] if clusters is not None else [("warning", "missing clusters")])
    out = spark.createDataFrame(missing, "severity string, problem string")
    for c in (c for c in required if c in pool.columns):
        bad = pool.agg(F.count_if(F.col(c).isNull()).alias("n")).filter("n > 0")
        out = out.unionByName(bad.select(F.lit("error").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(f" nulls in {c}")).alias("problem")))
    return out


#: Parts of a pool: tables by frame_id that must be there, those that may be, and other tables that may be.
POOL_PARTS, POOL_MAY, POOL_OTHER = ("features", "phones", "genders", "symbols"), ("speakers", "patterns"), ("centers", "utterances")
COLUMN_OF = {"features": "feature", "phones": "phone", "genders": "gender", "symbols": "symbol", "speakers": "speaker", "patterns": "pattern"}


@dataclass
class Pool:
    frames: DataFrame
    centers: DataFrame | None
    utterances: DataFrame | None
    settings: dict


def save_pool(frames: DataFrame, path: str, centers: DataFrame | None = None, utterances: DataFrame | None = None, settings: dict | None = None) -> list[str]:
    """A target pool as one table a part below path, checked afterwards: see pool_errors. Returns the warnings; errors raise ValueError."""
    spark, root = frames.sparkSession, path.rstrip("/")
    for part, column in COLUMN_OF.items():
        if column in frames.columns:
            frames.select("frame_id", column).write.mode("overwrite").parquet(f"{root}/{part}")
    for part, table in (("centers", centers), ("utterances", utterances)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{root}/{part}")
    spark.createDataFrame([(json.dumps(settings or {}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/settings")
    errors, warnings = pool_errors(spark, root)
    if errors:
        raise ValueError("; ".join(errors))
    return warnings


def pool_errors(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(errors, warnings): a missing required part, parts of unequal numbers of rows or other frames are errors; a missing part that may be there, or
    settings without the number of dimensions, a warning."""
    root = path.rstrip("/")
    there = [p for p in (*POOL_PARTS, *POOL_MAY) if exists(spark, f"{root}/{p}/_SUCCESS")]
    errors = [f"missing {p}" for p in POOL_PARTS if p not in there]
    warnings = [f"missing {p}" for p in (*POOL_MAY, *POOL_OTHER) if not exists(spark, f"{root}/{p}/_SUCCESS")]
    tables = {p: spark.read.parquet(f"{root}/{p}").select("frame_id") for p in there}
    counts = {p: t.count() for p, t in tables.items()}
    if len(set(counts.values())) > 1:
        errors.append(f"unequal lengths: {counts}")
    elif "features" in tables:
        errors += [f"{p} of other frames" for p, t in tables.items() if p != "features" and not t.join(tables["features"], "frame_id", "left_anti").isEmpty()]
    if not exists(spark, f"{root}/settings") or "dims" not in json.loads(spark.read.text(f"{root}/settings").first()[0]):
        warnings.append("settings without dims")
    return errors, warnings


def load_pool(spark: SparkSession, path: str) -> Pool:
    """A pool of any layout: parts as save_pool writes them, one table `pool` with all columns, as the offline plan does, or NumPy arrays (`npy`), with
    centers by phone in phone_clusters.npz. Parts that may be missing are left out."""
    root = path.rstrip("/")
    table = lambda p: spark.read.parquet(f"{root}/{p}") if exists(spark, f"{root}/{p}/_SUCCESS") else None
    if any(exists(spark, f"{root}/{part}.npy") for part in npy.REQUIRED):
        centers = npy.clusters(spark, f"{root}/phone_clusters.npz") if exists(spark, f"{root}/phone_clusters.npz") else None
        return Pool(npy.read_pool(spark, root), centers, None, {})
    frames = table("features")
    if frames is None:
        frames = table("pool")
        if frames is None:
            raise FileNotFoundError(f"neither features nor pool in {root}")
    else:
        for part in COLUMN_OF:
            if part != "features" and (more := table(part)) is not None:
                frames = frames.join(more, "frame_id")
    settings = json.loads(spark.read.text(f"{root}/settings").first()[0]) if exists(spark, f"{root}/settings") else {}
    return Pool(frames, table("centers"), table("utterances"), settings)
