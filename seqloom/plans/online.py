"""The online plan: an utterance's frames are cleaned, coded, cut into phones, given durations, replaced by centers of the pool and stretched."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import cluster, knn, linalg, prosody, sequence
from seqloom.storage import stored


def anonymized(
    frames: DataFrame,
    centers: DataFrame,
    basis: np.ndarray | None = None,
    codebook: np.ndarray | None = None,
    mode: str = "same",
    predicted: str | None = None,
    duration_weight: float = 0.5,
) -> DataFrame:
    """(utt, i, feature): frames (frame_id, utt, t, phone, gender m or f, feature) through the plan.

    centers: (phone, gender, center_id, center), gender null for those of a phone alone. predicted: a column of
    predicted durations of the frame's phone; without it, durations stay.
    """
    rows = frames if basis is None else linalg.projected_out(frames, basis).withColumn("feature", F.col("cleaned"))
    rows = rows if codebook is None else cluster.encode(rows, codebook, out="symbol")
    rows = rows.withColumn("gender", prosody.target_gender(F.col("gender"), mode))
    one, any_gender = centers.filter("gender is not null"), centers.filter("gender is null").drop("gender")
    found = knn.cluster_retriever(rows, one, levels=(("phone", "gender"),))
    rest = knn.cluster_retriever(rows.join(found.filter("not found").select(F.col("query_id").alias("frame_id")), "frame_id", "left_semi"), any_gender, levels=(("phone",),))
    vectors = found.filter("found").unionByName(rest).select(F.col("query_id").alias("frame_id"), F.col("vector").alias("new"))
    rows = stored(rows.join(vectors, "frame_id").select("utt", "t", "phone", F.col("new").alias("feature"), *([predicted] if predicted else [])), "replaced")
    if not predicted:
        return rows.select("utt", F.col("t").alias("i"), "feature")
    placed = sequence.positioned(rows, "utt", ["t"])
    segs = sequence.durations(sequence.segments(rows, "utt", ["t"], "phone"))
    spans = segs.select("utt", "seg", "duration", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    both = placed.join(spans, ["utt", "pos"]).withColumn("key", F.concat_ws("/", "utt", "seg"))
    want = both.groupBy("utt", "seg", "key").agg(prosody.mixed_duration(F.avg(predicted), F.max("duration").cast("double"), duration_weight).alias("m"))
    stretched = sequence.resample_linear(both.drop("utt", "seg").join(want.select("key", "m"), "key"), "key", ["pos"], "feature", "m")
    out = stretched.join(want.select("utt", "seg", "key"), "key")
    return sequence.positioned(out, "utt", ["seg", "i"]).select("utt", F.col("pos").alias("i"), "feature")
