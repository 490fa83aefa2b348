"""Exact nearest neighbours that leave out what can't be near.

Both sides are dealt into cells, rows whose nearest of some coarse centers is the same, and those into units: rows of one key and cell, cut at medians
into pieces of `block_rows` that lie close together. Of each unit and each cell its mean, radius and least and largest norm are known, and so a bound on how near
two rows of two of them can be.

1. Each unit of queries meets the nearest units of the pool that together have k rows. Each query's k-th score so far is a bound.
2. A unit of queries meets the other units of the pool whose bound isn't behind the worst k-th score of its queries; in the task, queries whose
   own k-th score is ahead of what the unit can offer are left out.

Units are only looked at in cells that pass the same tests, so no task has all units; the number of cells follows the number of rows. Vectors are
copied once for each batch of units that a unit meets, so a skipped unit costs a row of a table of units. The centers only steer the
search; they are fitted on a bounded sample, and any centers give the same rows as comparing all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import vec
from seqloom.operators import blocks
from seqloom.operators.cluster import codebook, encode
from seqloom.operators.knn import DIGITS, METRICS, _scores
from seqloom.storage import stored

#: Rows that the coarse centers are fitted on.
FIT_ROWS = 50_000
#: Rows for which there is a cell, and cells at most; rows of a cell that are cut into units in one task.
CELL_ROWS, MOST_CELLS, PART_ROWS = 32_768, 4096, 65_536
#: Pool rows that a unit of queries meets at once, unless a unit has more; pairs of units that a task bounds at once.
MEET_ROWS, BOUND_PAIRS = 2048, 1 << 20
FACTS = "n bigint, center array<double>, radius double, low double, high double"


def coarse(pool: DataFrame, cells: int, vector: str, id: str) -> np.ndarray:
    """Centers from a sample of FIT_ROWS rows at most, drawn by a hash of the id: `cells`, more where that leaves more than CELL_ROWS rows to each."""
    n = pool.count()
    share = max(1, -(-n // FIT_ROWS))
    cells = max(cells, min(MOST_CELLS, -(-n // CELL_ROWS)))
    return codebook(pool.filter(F.pmod(F.xxhash64(id), F.lit(share)) == 0), cells, vector, id, steps=5)


def pieces(x: np.ndarray, most: int) -> np.ndarray:
    """The piece of each row: rows are halved at the median of the dimension in which they lie widest apart until a piece has `most` rows at most."""
    out, left, n = np.zeros(len(x), dtype=np.int64), [np.arange(len(x))], 0
    while left:
        rows = left.pop()
        if len(rows) <= most:
            out[rows], n = n, n + 1
            continue
        own = x[rows]
        rows = rows[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
        left += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return out


def units(rows: DataFrame, keys: list[str], centers: np.ndarray, block_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (keys, id, v) with unit, stored, and the units (keys, unit, n, center, radius, low, high): means, radii, least and largest norms. The upper
    32 bits of a unit are its cell."""
    cells = encode(rows, centers, "v", "cell") if len(centers) else rows.withColumn("cell", F.lit(0))
    cells = stored(cells, f"{name}-cells")
    parts = cells.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("__p"))
    part = F.pmod(F.xxhash64("id"), F.col("__p"))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        first = (t.column("cell")[0].as_py() << 32) + (t.column("part")[0].as_py() << 20)
        return t.drop_columns(["cell", "part"]).append_column("unit", pa.array(first + pieces(blocks.matrix(t, "v"), block_rows)))

    kinds = T.StructType([rows.schema[c] for c in (*keys, "id", "v")] + [T.StructField("unit", T.LongType())])
    dealt = cells.join(parts, [*keys, "cell"], "left").withColumn("part", part).select(*keys, "id", "v", "cell", "part")
    dealt = stored(dealt.groupBy(*keys, "cell", "part").applyInArrow(cut, kinds), f"{name}-units")

    def facts(t: pa.Table) -> pa.Table:
        x = blocks.matrix(t, "v")
        mean, norms = x.mean(0), np.sqrt((x * x).sum(1))
        numbers = [len(x), mean.tolist(), float(np.sqrt(((x - mean) ** 2).sum(1)).max()), float(norms.min()), float(norms.max())]
        own = [t.column(c).slice(0, 1) for c in (*keys, "unit")]
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64())
        return pa.table([*own, *(pa.array([v], k) for v, k in zip(numbers, kinds))], names=[*keys, "unit", "n", "center", "radius", "low", "high"])

    schema = T.StructType([dealt.schema[c] for c in (*keys, "unit")] + T._parse_datatype_string(FACTS).fields)
    return dealt, stored(dealt.groupBy(*keys, "unit").applyInArrow(facts, schema), f"{name}-facts")


def least(a: dict[str, np.ndarray], b: dict[str, np.ndarray], metric: str) -> np.ndarray:
    """The least score (smaller is nearer) that a row of a unit of a and one of b can have, for all pairs of units."""
    apart = _scores(a["center"], b["center"], "l2")
    reach = a["radius"][:, None] + b["radius"][None, :]
    gap = np.maximum(apart - reach - 1e-9 * (1 + apart), 0)
    if metric == "l2":
        return np.maximum.reduce([gap, b["low"][None, :] - a["high"][:, None], a["low"][:, None] - b["high"][None, :]])
    high = a["high"][:, None] * b["high"][None, :]
    lengths = [np.sqrt((x["center"] ** 2).sum(1)) for x in (a, b)]
    around = a["center"] @ b["center"].T + np.outer(lengths[0], b["radius"]) + np.outer(a["radius"], lengths[1]) + np.outer(a["radius"], b["radius"])
    between = (a["high"][:, None] ** 2 + b["high"][None, :] ** 2 - gap**2) / 2
    return -np.minimum.reduce([high, around, between]) - 1e-9 * (1 + high)


def _facts(t: pa.Table) -> dict[str, np.ndarray]:
    return {"center": blocks.matrix(t, "center"), **{c: t.column(c).to_numpy() for c in ("radius", "low", "high")}}


def _cells(units: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """What is known of units, of the cells that they are in: (keys, cell, n, center, radius, low, high), and the greatest bound of their queries."""
    rows = units.withColumn("cell", F.shiftright("unit", 32))

    def whole(t: pa.Table) -> pa.Table:
        x, n = _facts(t), t.column("n").to_numpy()
        mean = n @ x["center"] / n.sum()
        radius = np.sqrt(((x["center"] - mean) ** 2).sum(1)) + x["radius"]
        numbers = [n.sum(), mean.tolist(), radius.max(), x["low"].min(), x["high"].max(), *([t.column("bound").to_numpy().max()] if bounded else [])]
        own = [t.column(c).slice(0, 1) for c in (*keys, "cell")]
        return pa.table([*own, *(pa.array([v], f.type) for v, f in zip(numbers, kinds))], names=schema.names)

    schema = T.StructType([rows.schema[c] for c in (*keys, "cell")] + T._parse_datatype_string(FACTS + (", bound double" if bounded else "")).fields)
    kinds = [pa.field(f.name, pa.list_(pa.float64()) if f.name == "center" else pa.int64() if f.name == "n" else pa.float64()) for f in schema.fields[len(keys) + 1 :]]
    return rows.groupBy(*keys, "cell").applyInArrow(whole, schema)


def _near(a: pa.Table, b: pa.Table, metric: str, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b): with k, the nearest of b that have k rows together, nearest first; else those that aren't behind a's bound."""
    x, y, n = _facts(a), _facts(b), b.column("n").to_numpy()
    found = []
    for at in range(0, len(a), step := max(1, BOUND_PAIRS // max(1, len(b)))):
        some = {c: v[at : at + step] for c, v in x.items()}
        if k is None:
            own, other = np.nonzero(least(some, y, metric) <= a.column("bound").to_numpy()[at : at + step, None])
        else:
            order = np.argsort(_scores(some["center"], y["center"], "l2" if metric == "l2" else "dot"), axis=1, kind="stable")
            own, place = np.nonzero(np.cumsum(n[order], axis=1) - n[order] < k)
            other = order[own, place]
        found.append((own + at, other))
    return tuple(np.concatenate(z) for z in zip(*found))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], metric: str, k: int | None) -> DataFrame:
    """(keys, block, unit, n_block, n_unit): with k, near units of the pool that have k rows together, for each unit of queries; else those that aren't
    behind its `bound`. Cells are paired first, then the units of each pair of cells."""

    def paired(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("cell")
        own, other = _near(a, b, metric, k)
        return pa.table([*(a.column(c).take(pa.array(own)) for c in (*keys, "cell")), b.column("cell").take(pa.array(other))], names=among.names)

    cells = _cells(left, keys, k is None)
    among = T.StructType([cells.schema[c] for c in (*keys, "cell")] + [T.StructField("near", T.LongType())])
    near = stored(blocks.met(cells, _cells(right, keys, False), keys, paired, among, "cell", 256), "cell-pairs")
    queries = left.withColumn("cell", F.shiftright("unit", 32))
    pool = right.withColumn("near", F.shiftright("unit", 32)).join(near, [*keys, "near"]).drop("near")
    schema = T.StructType([left.schema[c] for c in keys] + T._parse_datatype_string("block bigint, unit bigint, n_block bigint, n_unit bigint").fields)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("unit")
        own, other = (pa.array(z) for z in _near(a, b, metric, k))
        columns = [*(a.column(c).take(own) for c in (*keys, "unit")), b.column("unit").take(other), a.column("n").take(own), b.column("n").take(other)]
        return pa.table(columns, names=schema.names)

    return blocks.met(queries, pool, [*keys, "cell"], work, schema, "unit")


def search(
    queries: DataFrame,
    pool: DataFrame,
    keys: list[str],
    k: int,
    metric: str = "cosine",
    query_id: str = "frame_id",
    pool_id: str = "frame_id",
    query_vector: str = "feature",
    pool_vector: str = "feature",
    exclude_self: bool = False,
    block_rows: int = 2048,
    cells: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """The rows that `knn.nearest` gives, and (possible, compared, share): pairs of a query and a pool row of its key, those that have met in a task, and
    their share."""
    if metric not in METRICS:
        raise ValueError(metric)
    own = keys or ["__one"]

    def side(df: DataFrame, id: str, vector: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        v = vec.normalized(v, 1e-300) if metric == "cosine" else v
        rows = df.select(F.col(id).cast("bigint").alias("id"), *(F.col(c) for c in keys), v.alias("v"))
        rows = rows if keys else rows.withColumn("__one", F.lit(1))
        return rows.filter(F.col("v").isNotNull()).dropna(subset=own)

    q, p = side(queries, query_id, query_vector), stored(side(pool, pool_id, pool_vector), "pool")
    centers = coarse(p, cells, "v", "id") if not p.isEmpty() else np.zeros((0, 0))
    (q, q_units), (p, p_units) = units(q, own, centers, block_rows, "queries"), units(p, own, centers, block_rows, "pool")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = blocks.matrix(left, "v"), blocks.matrix(right, "v")
        ids, pool_ids, kth = left.column("id").to_numpy(), right.column("id").to_numpy(), left.column("kth").to_numpy()
        if len(a) and len(b) and np.isfinite(kth).any():
            mean, norms = b.mean(0), np.sqrt((b * b).sum(1))
            unit = {"center": mean[None, :], "radius": np.sqrt(((b - mean) ** 2).sum(1)).max(keepdims=True), "low": norms.min(keepdims=True), "high": norms.max(keepdims=True)}
            lengths = np.sqrt((a * a).sum(1))
            ahead = least({"center": a, "radius": np.zeros(len(a)), "low": lengths, "high": lengths}, unit, metric)[:, 0] <= kth
            a, ids, kth = a[ahead], ids[ahead], kth[ahead]
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "pool_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(pool_ids, kind="stable")
        b, pool_ids = b[order], pool_ids[order]
        s = np.round(_scores(a, b, metric), DIGITS) + 0.0
        if exclude_self:
            s[ids[:, None] == pool_ids[None, :]] = np.inf
        best = np.argsort(s, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(s, best, 1)
        keep = (np.isfinite(found) & (found <= kth[:, None])).ravel()
        return pa.table({"query_id": np.repeat(ids, best.shape[1])[keep], "pool_id": pool_ids[best].ravel()[keep], "score": found.ravel()[keep]})

    def met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        # tables of a row a vector or a pair of units are joined by sorting: copies pack into files that look small enough to broadcast, but aren't
        # a unit of queries meets its units of the pool in batches of about MEET_ROWS rows
        many = pairs.groupBy(*own, "block").agg(F.ceil(F.sum("n_unit") / MEET_ROWS).alias("__b"))
        batch = F.pmod(F.xxhash64("unit"), F.col("__b")).alias("batch")
        dealt = pairs.join(many, [*own, "block"]).select(*own, "block", "unit", batch)
        left = dealt.select(*own, "block", "batch").distinct().join(rows.withColumnRenamed("unit", "block").hint("merge"), [*own, "block"]).select(*own, "block", "batch", "id", "v", "kth")
        right = dealt.join(p.hint("merge"), [*own, "unit"]).select(*own, "block", "batch", "id", "v")
        left, right = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (left, right))  # new columns, for both may come from one table
        by = [*own, "block", "batch"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, "query_id bigint, pool_id bigint, score double")

    first = stored(_pairs(q_units, p_units, own, metric, k + exclude_self), "first-pairs")
    found = stored(met(q.withColumn("kth", F.lit(float("inf"))), first), "first-found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "pool_id"))
    kth = found.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    # scores are rounded to six digits, so a row just behind may tie
    known = stored(q.join(kth.hint("merge"), "id", "left").withColumn("kth", F.coalesce(F.col("kth") + F.lit(1e-6), F.lit(float("inf")))), "known")
    bound = known.groupBy(*own, "unit").agg(F.max("kth").alias("bound"))
    rest = _pairs(q_units.join(bound, [*own, "unit"]), p_units, own, metric, None)
    rest = stored(rest.join(first.select(*own, "block", "unit"), [*own, "block", "unit"], "left_anti"), "rest-pairs")
    best = found.unionByName(met(known, rest)).withColumn("rank", rank).filter(F.col("rank") <= k)
    rows = best.select("query_id", "rank", "pool_id", (F.col("score") if metric == "l2" else -F.col("score")).alias("score"))
    sides = [d.groupBy(*own).agg(F.sum("n").alias(c)) for d, c in ((q_units, "a"), (p_units, "b"))]
    possible = sides[0].join(sides[1], own).agg(F.sum(F.col("a") * F.col("b")).alias("possible"))
    compared = first.unionByName(rest).agg(F.sum(F.col("n_block") * F.col("n_unit")).alias("compared"))
    return rows, possible.crossJoin(F.broadcast(compared)).withColumn("share", F.col("compared") / F.col("possible"))
