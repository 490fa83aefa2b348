"""The offline plan: frames -> cleaned frames -> codebook -> symbol patterns -> pool. Each step is a table under one root, so a run can begin anywhere
and goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import cluster, linalg, sequence
from seqloom.plans import resume

DEFAULTS = {"dims": 64, "speaker_directions": 8, "least_utterances": 5, "codes": 64, "steps": 20, "alpha": 0.1, "clusters": 8, "group_rows": 50_000, "buckets": 0, "skip_on_error": False}
NEEDS = {"subspace": ["frames"], "cleaned": ["frames", "subspace"], "codebook": ["cleaned"], "symbols": ["cleaned", "codebook"], "patterns": ["symbols"], "pool": ["cleaned", "symbols"], "centers": ["cleaned"]}


def _vectors(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, v array<double>")


@dataclass
class Offline:
    spark: SparkSession
    root: str
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        self.settings = DEFAULTS | self.settings

    def path(self, step: str) -> str:
        return f"{self.root.rstrip('/')}/{step}"

    def has(self, step: str) -> bool:
        """Whether the step's table is there, written to its end."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(step) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(self.path(step))

    def matrix(self, step: str) -> np.ndarray:
        return np.array([r["v"] for r in self.table(step).orderBy("i").collect()])

    def status(self) -> dict[str, bool]:
        return {step: self.has(step) for step in ["frames", *NEEDS]}

    def missing(self, step: str) -> list[str]:
        return [n for n in NEEDS[step] if not self.has(n)]

    def work(self) -> dict[str, Callable[[], DataFrame]]:
        s = self.settings
        frames = lambda: self.table("cleaned").withColumn("feature", F.col("cleaned"))
        states = lambda: self.table("symbols").select(F.col("symbol").alias("state")).distinct()
        return {
            "subspace": lambda: _vectors(self.spark, linalg.subspace(self.table("frames"), "speaker", s["dims"], s["speaker_directions"], least=s["least_utterances"])["basis"]),
            "cleaned": lambda: self._in_buckets("cleaned", self.table("frames"), lambda rows: linalg.projected_out(rows, self.matrix("subspace"))),
            "codebook": lambda: _vectors(self.spark, cluster.codebook(frames(), s["codes"], steps=s["steps"])),
            "symbols": lambda: self._in_buckets("symbols", frames(), self._symbols),
            "patterns": lambda: sequence.transition_matrix(sequence.bigrams(self.table("symbols"), "utt", ["t"], "symbol"), states(), s["alpha"]),
            "pool": lambda: frames().select("frame_id", "utt", "phone", "gender", "speaker", "feature").join(self.table("symbols").select("frame_id", "symbol"), "frame_id"),
            "centers": lambda: self._centers(frames()),
        }

    def _symbols(self, frames: DataFrame) -> DataFrame:
        return cluster.encode(frames, self.matrix("codebook"), out="symbol").select("frame_id", "utt", "t", "phone", "symbol")

    def _in_buckets(self, step: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """work over the rows; with the setting `buckets`, by buckets of utterances, so that a run that breaks goes on within the step."""
        if not self.settings["buckets"]:
            return work(rows)
        return resume.in_buckets(rows, work, f"{self.path(step)}-buckets", "utt", self.settings["buckets"])

    def _centers(self, frames: DataFrame) -> DataFrame:
        """Centers by (phone, gender) and by phone, gender then null."""
        s = self.settings
        both = cluster.group_centers(frames, ["phone", "gender"], s["clusters"], fit_rows=s["group_rows"])
        alone = cluster.group_centers(frames, ["phone"], s["clusters"], fit_rows=s["group_rows"]).withColumn("gender", F.lit(None).cast(dict(both.dtypes)["gender"]))
        return cluster.numbered(both.unionByName(alone), ["phone", "gender"])

    def run(self, steps: list[str] | None = None, again: bool = False) -> dict[str, str]:
        """The outcome of each step: done, kept (it was there), or the error, if settings say to go on after one."""
        out = {}
        for step, make in self.work().items():
            if steps is not None and step not in steps:
                continue
            if self.has(step) and not again:
                out[step] = "kept"
                continue
            try:
                if gone := self.missing(step):
                    raise RuntimeError(f"{step} needs {gone}")
                make().write.mode("overwrite").parquet(self.path(step))
                out[step] = "done"
            except Exception as e:
                if not self.settings["skip_on_error"]:
                    raise
                out[step] = f"{type(e).__name__}: {e}"
        return out
