"""Tables in the folder that all executors share, and positions in long sequences."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one sequence that a window or a Python group takes at once.
CHUNK = 65_536


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and all runs on this machine, as in tests, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_here = threading.local()


def _scopes() -> list[list[str]]:
    """The scratches around what this thread does, each with its tables' paths."""
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    return _here.scopes


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables stored meanwhile, but for those that outlive it."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            _delete(spark, path)


def new_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A fresh path in the shared folder, deleted with the scratch around it (with the one around that, if it outlives it) or else when the driver's
    interpreter ends."""
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex[:12]}-{name}"
    around = _scopes()[: len(_scopes()) - outlives]
    if around:
        around[-1].append(path)
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """df written and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name, outlives)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, key: str, order: list[str], name: str = "positions") -> DataFrame:
    """df with pos, the place of each row within its key from 0.

    Rows are range-partitioned by (key, order), so a key of any size is spread over partitions; one number for each
    key that a partition begins with or ends with corrects the local places. No window holds a whole key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("__part", F.shiftright("__at", 33)), name)
    runs = placed.groupBy(F.col(key).alias("__key"), F.col("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a key has a run in each partition it reaches at most, so this window holds no more rows than there are partitions
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("__key", F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    out = placed.join(before, placed[key].eqNullSafe(before["__key"]) & (placed["__part"] == before["__p"]))
    return out.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__key", "__p", "__first", "__before")


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str = "sum", name: str = "sums") -> DataFrame:
    """df with the sum of value over the rows of the key so far, this one included. As positioned, no window holds a whole key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, key, *order).withColumn("__part", F.spark_partition_id()), name)
    here = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__key", "__p", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    rows = placed.withColumn("__here", F.sum(value).over(here))
    rows = rows.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return rows.withColumn(out, F.col("__here") + F.col("__before")).drop("__here", "__before", "__key", "__p", "__part")


def chunked(df: DataFrame, key: str, order: list[str], before: int = 0, after: int = 0, chunk: int = CHUNK, align: int = 1) -> DataFrame:
    """df with pos, chunk and halo: sequences cut into chunks of bounded size, each with copies of the rows next to it.

    Windows over (key, chunk) see `before` rows of the chunk before and `after` of the one behind; rows with halo are
    those copies, to be left out afterwards. align: chunks begin at multiples of it.
    """
    chunk = max(align, chunk // align * align, before, after)
    rows = positioned(df, key, order)
    own = F.floor(F.col("pos") / chunk)
    near = F.array(own, F.when(F.col("pos") % chunk < after, own - 1), F.when(F.col("pos") % chunk >= chunk - before, own + 1))
    wanted = F.filter(F.array_distinct(near), lambda c: c.isNotNull() & (c >= 0))
    return rows.withColumn("__own", own).withColumn("chunk", F.explode(wanted)).withColumn("halo", F.col("chunk") != F.col("__own")).drop("__own")


def by_chunk(df: DataFrame, key: str) -> DataFrame:
    """df dealt by (key, chunk) to as many partitions as shuffles have. Symbols pack so well that Spark, which goes by packed sizes, would otherwise put all
    rows of a large table into a few tasks to be sorted there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "chunk")
