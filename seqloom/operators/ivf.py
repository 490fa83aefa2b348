"""Inverted files: a pool saved by (key, cell), so that a search reads the cells that its queries look into and no others.

Each key (a phone, a gender) has an index of its own, as its rows are clustered by themselves: min(most, sqrt(rows)) cells, or one, which is an
exact search, where it has fewer than `flat_below` rows. The table is partitioned by key and cell; a search joins it with the wanted
cells, which Spark turns into dynamic partition pruning, so other cells' files aren't opened.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import vec
from seqloom.operators import blocks, cluster, knn
from seqloom.storage import stored

#: Wanted cells that are broadcast; more are joined by a shuffle and prune no partitions.
MOST_CELLS = 100_000
#: Scores that a task makes at once, and pool rows of them.
HELD_PAIRS, PAIR_COLUMNS = 1 << 20, 2048


@dataclass
class Index:
    """rows: keys, cell, id and vector; centers: keys, cell, center. A row of centers a cell."""

    rows: DataFrame
    centers: DataFrame
    keys: list[str]
    id: str
    vector: str


def save(
    pool: DataFrame,
    path: str,
    keys: list[str],
    most: int = 256,
    flat_below: int = 1000,
    least: int = 1,
    id: str = "frame_id",
    vector: str = "feature",
    steps: int = 10,
) -> None:
    """Writes an index of the pool, by key. Vectors are clustered as unit vectors. Keys of fewer than `least` rows have none, nor has a null key."""
    rows = pool.dropna(subset=[*keys, vector]).select(*keys, F.col(id).cast("bigint").alias(id), F.col(vector).cast("array<double>").alias(vector))
    rows = stored(rows.withColumn("__u", vec.normalized(F.col(vector))), "index-rows")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    large, small = (rows.join(sizes.filter(test).drop("__n"), keys, "left_semi") for test in (F.col("__n") >= flat_below, F.col("__n") < flat_below))
    centers = cluster.group_centers(large, keys, most, "__u", id, steps, few="sqrt").select(*keys, F.col("center_no").alias("cell"), "center")
    flat = small.groupBy(*keys).agg(F.min_by("__u", id).alias("center")).select(*keys, F.lit(0).alias("cell"), "center")
    root = path.rstrip("/")
    flat.unionByName(centers).write.mode("overwrite").parquet(f"{root}/centers")
    saved = pool.sparkSession.read.parquet(f"{root}/centers")
    placed = cluster.assigned(large, saved.withColumnRenamed("cell", "center_no"), keys, "__u", id).withColumnRenamed("center_no", "cell")
    out = placed.unionByName(small.withColumns({"cell": F.lit(0), "distance": F.lit(0.0)})).select(*keys, "cell", id, vector)
    # rebalanced: one cell's rows meet in a few files, and a cell of many rows is split over several tasks
    out.hint("rebalance", *keys, "cell").write.mode("overwrite").partitionBy(*keys, "cell").parquet(f"{root}/rows")
    facts = {"keys": keys, "id": id, "vector": vector, "schema": out.select(id, vector, *keys, "cell").schema.jsonValue()}
    pool.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/facts")


def load(spark: SparkSession, path: str) -> Index:
    root = path.rstrip("/")
    facts = json.loads(spark.read.text(f"{root}/facts").first()[0])
    rows = spark.read.schema(T.StructType.fromJson(facts["schema"])).parquet(f"{root}/rows")
    return Index(rows, spark.read.parquet(f"{root}/centers"), facts["keys"], facts["id"], facts["vector"])


def _slim(index: Index, queries: DataFrame, vector: str, id: str) -> DataFrame:
    """(keys, id, v, u) of the queries that can have cells; u: the unit vector."""
    slim = queries.dropna(subset=[*index.keys, vector]).select(*index.keys, F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return slim.withColumn("u", vec.normalized(F.col("v")))


def _order(q: pa.Table, c: pa.Table, most: int | None) -> np.ndarray:
    """For each query the places of its nearest cells in c, which is sorted by cell."""
    return np.argsort(np.round(blocks.squared_distances(blocks.matrix(q, "u"), blocks.matrix(c, "center")), 9), axis=1, kind="stable")[:, :most]


def _ordered(index: Index, queries: DataFrame, vector: str, id: str) -> DataFrame:
    """(keys, id, cell, order): for each query all cells, the nearest first."""
    keys, slim = index.keys, _slim(index, queries, vector, id).drop("v")

    def work(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("cell")
        order = _order(q, c, None)
        at = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
        own = [q.column(n).take(at) for n in (*keys, "id")]
        return pa.table([*own, c.column("cell").take(pa.array(order.ravel())), pa.array(np.tile(np.arange(1, order.shape[1] + 1), len(order)), pa.int32())], names=schema.names)

    schema = T.StructType([*(slim.schema[c] for c in (*keys, "id")), T.StructField("cell", T.IntegerType()), T.StructField("order", T.IntegerType())])
    return blocks.met(slim, index.centers, keys, work, schema, "id")


def _dealt(index: Index, queries: DataFrame, groups: DataFrame, most: int, vector: str, id: str) -> DataFrame:
    """(keys, group, id, v, cells): for each query its `most` nearest cells, a row for each group of cells that they are in. Cells without rows are in none."""
    keys, slim = index.keys, _slim(index, queries, vector, id)
    centers = index.centers.join(groups.select(*keys, "cell", "group"), [*keys, "cell"], "left").withColumn("group", F.coalesce("group", F.lit(-1)))

    def work(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("cell")
        order = np.sort(_order(q, c, most), axis=1)  # by cell, so by group
        group, cell = (c.column(n).to_numpy().astype(np.int32) for n in ("group", "cell"))
        row, at = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
        row, at = row[group[at] >= 0], at[group[at] >= 0]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group[at], prepend=-1) != 0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(cell[at]))
        own = {n: q.column(n).take(pa.array(row[first])) for n in (*keys, "id", "v")}
        return pa.table([*(own[n] for n in keys), pa.array(group[at[first]]), own["id"], own["v"], lists], names=schema.names)

    schema = T.StructType([*(slim.schema[c] for c in keys), T.StructField("group", T.IntegerType()), slim.schema["id"], slim.schema["v"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return blocks.met(slim, centers, keys, work, schema, "id")


def _best(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores s of queries q and pool rows p the k least of each query, ties by the smaller p."""
    order = np.lexsort((p, s, q))
    q, p, s = q[order], p[order], s[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], p[keep], s[keep]


def _scored(left: pa.Table, right: pa.Table, k: int, metric: str, exclude_self: bool) -> pa.Table:
    """(query_id, pool_id, score): for each query of left the k nearest of right's rows that are in its cells."""
    right = right.sort_by([("cell", "ascending"), ("pool_id", "ascending")])
    x, y, ids, pool_ids = blocks.matrix(left, "v"), blocks.matrix(right, "v"), left.column("id").to_numpy(), right.column("pool_id").to_numpy()
    cell, first = np.unique(right.column("cell").to_numpy(), return_index=True)
    lists = left.column("cells").combine_chunks()
    wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(left)), lists.value_lengths().to_numpy())
    wants = np.split(who[(by := np.argsort(wanted, kind="stable"))], np.searchsorted(wanted[by], cell[1:]))
    wants = [w[np.isin(wanted[by[a : a + len(w)]], c)] for w, c, a in zip(wants, cell, np.cumsum([0, *map(len, wants)]))]
    spans = list(zip(first, np.append(first[1:], len(y)), wants))
    if all(len(w) == len(x) for w in wants):  # all want all cells
        spans = [(0, len(y), np.arange(len(x)))]
    none = np.zeros(0, np.int64)
    held, n, best = [], 0, (none, none, np.zeros(0))
    for a, z, w in spans:
        for lo in range(a, z, PAIR_COLUMNS):
            hi = min(z, lo + PAIR_COLUMNS)
            for at in range(0, len(w), step := max(1, HELD_PAIRS // (hi - lo))):
                some = w[at : at + step]
                s = np.round(knn._scores(x[some], y[lo:hi], metric), knn.DIGITS) + 0.0
                if exclude_self:
                    s[ids[some][:, None] == pool_ids[None, lo:hi]] = np.inf
                s[np.isnan(s)] = np.inf
                least = np.partition(s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else np.inf
                i, j = np.nonzero((s <= least) & (s < np.inf))
                held.append((some[i], pool_ids[lo:hi][j], s[i, j]))
                n += len(i)
                if n > HELD_PAIRS:
                    best = _best(*(np.concatenate(c) for c in zip(best, *held)), k)
                    held, n = [], 0
    q, p, s = _best(*(np.concatenate(c) for c in zip(best, *held)), k)
    return pa.table([pa.array(ids[q], pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "pool_id", "score"])


def search(
    index: Index,
    queries: DataFrame,
    k: int,
    probes: int,
    query_id: str = "frame_id",
    query_vector: str = "feature",
    metric: str = "cosine",
    exclude_self: bool = False,
    block_rows: int = 16_384,
) -> DataFrame:
    """knn.nearest within the queries' keys, over the `probes` cells nearest to each; with as many as there are it is exact.

    Cells of a key are taken together in groups of about block_rows rows. A query is sent once to each group that one of its cells is in, with the list of
    those, and not once a cell; in the task it meets the rows of its own cells only.
    """
    if metric not in knn.METRICS:
        raise ValueError(metric)
    keys, on = index.keys, [*index.keys, "cell"]
    sizes = index.rows.groupBy(*on).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # a row a cell of the key
    groups = stored(sizes.withColumn("group", F.floor(F.coalesce(before, F.lit(0)) / block_rows).cast("int")), "groups")
    probed = stored(_dealt(index, queries, groups, probes, query_vector, query_id), "probed")
    whole = [*keys, "group"]
    asked = probed.groupBy(*whole).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("q_blocks"))
    held = groups.groupBy(*whole).agg(F.ceil(F.sum("__n") / block_rows).cast("int").alias("p_blocks"))
    deals = stored(asked.join(held, whole), "deals")
    used = probed.select(*whole, F.explode("cells").alias("cell")).distinct()
    wanted = stored(used.join(deals, whole), "wanted").filter("q_blocks > 0")
    few = wanted.count() <= MOST_CELLS
    pool = index.rows.join(F.broadcast(wanted) if few else wanted, on).select(*whole, "cell", F.col(index.id).cast("bigint").alias("pool_id"), F.col(index.vector).alias("v"), "p_blocks", "q_blocks")
    qs, ps = blocks.alike(probed.join(deals, whole), pool, whole)
    qs = qs.withColumn("qb", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)))
    ps = ps.withColumn("pb", F.pmod(F.xxhash64("pool_id"), F.col("p_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "pool_id", "score"])
        return _scored(left, right, k, metric, exclude_self)

    by = [*whole, "qb", "pb"]
    qs, ps = (d.select(*(F.col(f"`{c}`").alias(c) for c in (*by, *columns))) for d, columns in ((qs, ("id", "v", "cells")), (ps, ("cell", "pool_id", "v"))))  # new columns, for both may come from one table
    partial = qs.groupBy(*by).cogroup(ps.groupBy(*by)).applyInArrow(work, "query_id bigint, pool_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "pool_id"))
    found = partial.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "pool_id", (F.col("score") if metric == "l2" else -F.col("score")).alias("score"))


def probes_for(
    index: Index,
    queries: DataFrame,
    k: int,
    target: float = 0.9,
    sample: int = 2000,
    query_id: str = "frame_id",
    query_vector: str = "feature",
    **how,
) -> int:
    """The fewest probes by which the share `target` of the exact neighbours is found, measured on a sample of queries of that size at most, drawn by
    a hash of the id: in which of its cells, counted from the nearest, each exact neighbour lies."""
    some = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(max(1, -(-queries.count() // sample)))) == 0)
    exact = knn.nearest(some, index.rows, index.keys, k, query_id=query_id, query_vector=query_vector, pool_id=index.id, pool_vector=index.vector, **how)
    cells = index.rows.select(F.col(index.id).alias("pool_id"), "cell")
    order = _ordered(index, some, query_vector, query_id).select(F.col("id").alias("query_id"), "cell", "order")
    found = exact.join(cells, "pool_id").join(order, ["query_id", "cell"]).groupBy("order").agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("order")) / F.sum("n").over(Window.partitionBy())
    first = found.withColumn("share", share).filter(F.col("share") >= target).agg(F.min("order")).first()[0]  # a row for each number of cells
    return first or 1
