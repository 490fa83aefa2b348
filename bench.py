"""Headline queries on one scale. Prints one JSON line with the median seconds of three warm runs of each."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from seqloom.plans import catalog

HEADLINES = [
    "rle_segments", "bigram_counts", "transition_matrix", "sliding_windows", "moving_average", "frame_continuity", "centroid_by_label", "confusion_entropy",
    "entropy_percentile_filter", "grouping_sets", "knn_cosine_top1", "knn_l2_topk_mean", "knn_softmax", "knn_ladder", "vq_encode", "lloyd_one_step",
    "ridge_sufficient_stats", "project_out_mean_direction", "phone_centers", "min_group_size", "kaldi_spk2utt", "jaccard", "wer", "ari_nmi", "silhouette",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("seqloom-bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINES:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        found[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm, median of 3", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
