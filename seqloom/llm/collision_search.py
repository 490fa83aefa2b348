"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Largest inner products are found as smallest distances: a vector x gets one more component, sqrt(M**2 - |x|**2) with M the largest norm, a query is
scaled to norm M and gets 0, so that |x - q|**2 = 2 M**2 - 2 M q.x / |q|.

* **Index.** Vectors are dealt by a hash of their rows into shards of bounded size. A shard holds, for each of m unit directions, the projections
  of all its vectors as one sorted array with their places. Directions are rows of random orthogonal matrices, scaled so that two vectors at
  distance d have projections apart by about d times a standard normal number. Every vector is in the index, which is a stored table.
* **Search.** A block of queries meets a shard in one task. Each query opens a window around its own projection in each array, from R / 2**6 on,
  doubling it (virtual rehashing: arrays are never hashed again, their windows grow by what lies between the old edges and the new ones). A
  vector's collisions are the windows that it has been in. From `threshold` collisions on it is verified: its inner product is computed from the
  original vectors, once.
* **End.** A vector at distance d collides under half-width R with probability p(R / d) in each array, p(x) = P(|N(0, 1)| <= x). `reach`
  is the ratio at which a vector has `threshold` collisions with the probability `target`. A query ends when its windows are `reach` times as wide
  as the k-th distance that it knows of; nearer vectors have been verified with at least that probability, whatever the data are. No number of
  candidates ends a search. A query that has opened all windows and still knows fewer than k verifies the rest of the shard.
* **Bound.** All queries meet the first shard before the others; the k-th distance found there bounds the windows in all others, so
  that a shard without near vectors costs little.

The price where distances hardly differ (random vectors of many dimensions): windows hold most of each array and some tenth of all vectors is
verified. Queries times shards is the work in any case; queries and shards meet as blocks, never as rows, and a row of k neighbours leaves
a task.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do null identifiers, nor vectors of
another length than most have (of equally frequent lengths the longest). Rows that repeat an identifier are rows of their own: a query's
candidates are all rows but its own one. Equal scores go by the smaller identifier. An empty table gives an empty result; with k
candidates or fewer, all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored

#: Rows of a shard; places in it are 16-bit numbers.
SHARD_ROWS = 16_384
#: Queries that meet a shard at once.
BLOCK_QUERIES = 4_096


def reach(m: int, threshold: int, target: float) -> float:
    """The ratio of window to distance at which m windows hold a vector `threshold` times with probability target."""
    low, high = 0.0, 40.0
    for _ in range(60):
        x = (low + high) / 2
        p = math.erf(x / math.sqrt(2))
        enough = sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(threshold, m + 1))
        low, high = (low, x) if enough >= target else (x, high)
    return high


def directions(dims: int, m: int, seed: int) -> np.ndarray:
    """m x dims: rows of random orthogonal matrices times sqrt(dims)."""
    rng, out = np.random.default_rng(seed), []
    while sum(map(len, out)) < m:
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out.append((q * np.sign(np.diag(r))).T * math.sqrt(dims))
    return np.concatenate(out)[:m]


class Settings:
    """m arrays, the share of them that must collide, the probability to verify a vector as near as the k-th, and the largest norm."""

    def __init__(self, dims: int, largest: float, m: int = 64, share: float = 0.68, target: float = 0.95, seed: int = 11):
        self.dims, self.largest, self.m = dims, largest, m
        self.threshold = max(1, round(share * m))
        self.reach = reach(m, self.threshold, target)
        self.directions = directions(dims + 1, m, seed)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """m x rows: the projections of the lengthened vectors."""
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return self.directions @ np.concatenate([x, rest[:, None]], axis=1).T

    def projected_queries(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.largest / np.sqrt((q * q).sum(1)))[:, None]
        return self.directions[:, :-1] @ scaled.T

    def distances(self, cosines: np.ndarray) -> np.ndarray:
        """From inner products over the query's norm."""
        return np.sqrt(np.maximum(2 * self.largest**2 - 2 * self.largest * cosines, 0))


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, float]:
    """(row, id, v) of the rows that take part, stored, their dimensions and their largest norm. row numbers them."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("largest"))
    lengths = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows, 0, 0.0
    return rows.filter(F.size("v") == lengths[0]["d"]), lengths[0]["d"], lengths[0]["largest"]


def index(rows: DataFrame, how: Settings, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The stored index of (row, id, v) and its number of shards. Each shard is a row: shard, ids, rows, vectors, keys (m sorted arrays) and places."""
    if shard_rows > 1 << 16:
        raise ValueError("a shard has 65,536 rows at most")
    shards = max(1, -(-rows.count() // (shard_rows * 9 // 10)))  # a tenth of room, for a hash doesn't deal evenly

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("row", "ascending")])
        x = np.stack(t.column("v").to_numpy()).astype(np.float64)
        keys = how.projected(x)
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, 1).astype(np.float32)
        packed = [t.column("id").to_numpy(), t.column("row").to_numpy(), x, keys, order.astype(np.uint16)]
        return pa.table([t.column("shard").slice(0, 1), *(pa.array([a.tobytes()], pa.binary()) for a in packed)], names=names)

    names = ["shard", "ids", "rows", "vectors", "keys", "places"]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, ids binary, rows binary, vectors binary, keys binary, places binary")
    return stored(built, "sorted-arrays"), shards


def _met(t: pa.Table, queries: pa.Table, how: Settings, k: int) -> list[tuple]:
    """(row, id, k-th distance, found ids, scores) of each query over one shard."""
    raw = {c: t.column(c)[0].as_py() for c in ("ids", "rows", "vectors", "keys", "places")}
    ids, own_rows = (np.frombuffer(raw[c], np.int64) for c in ("ids", "rows"))
    n = len(ids)
    x = np.frombuffer(raw["vectors"]).reshape(n, -1)
    keys, places = (np.frombuffer(raw[c], kind).reshape(-1, n) for c, kind in (("keys", np.float32), ("places", np.uint16)))
    q = np.stack(queries.column("v").to_numpy()).astype(np.float64)
    q_rows, q_ids, bound = (queries.column(c).to_numpy() for c in ("row", "id", "bound"))
    norms, at = np.sqrt((q * q).sum(1)), how.projected_queries(q).astype(np.float32)
    own = {r: i for i, r in enumerate(own_rows.tolist())}
    widest = how.reach * 2 * how.largest
    radius = np.full(len(q), widest / 64, dtype=np.float32)
    low = np.stack([np.searchsorted(keys[i], at[i]) for i in range(how.m)])
    high = low.copy()
    counts = np.zeros((len(q), n), np.uint8 if how.m < 256 else np.uint16)
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    kth, open_ = bound.copy(), np.arange(len(q))
    while len(open_):
        left, right = at[:, open_] - radius[open_], at[:, open_] + radius[open_]
        new_low = np.minimum(np.stack([np.searchsorted(keys[i], left[i]) for i in range(how.m)]), low[:, open_])
        new_high = np.maximum(np.stack([np.searchsorted(keys[i], right[i], "right") for i in range(how.m)]), high[:, open_])
        still = []
        for j, p in enumerate(open_.tolist()):
            parts = [places[i, a:b] for i, a, b in zip(range(how.m), new_low[:, j].tolist(), low[:, p].tolist()) if a < b]
            parts += [places[i, a:b] for i, a, b in zip(range(how.m), high[:, p].tolist(), new_high[:, j].tolist()) if a < b]
            if parts:
                before = counts[p] >= how.threshold
                counts[p] += np.bincount(np.concatenate(parts), minlength=n).astype(counts.dtype)
                _verify(p, np.flatnonzero((counts[p] >= how.threshold) & ~before), x, q, own.get(q_rows[p]), found, k)
            if len(found[p][1]) >= k:
                kth[p] = min(kth[p], how.distances(found[p][1][k - 1] / norms[p]))
            if radius[p] >= how.reach * kth[p]:
                continue
            if radius[p] >= widest:
                if len(found[p][1]) < k and bound[p] == np.inf:
                    _verify(p, np.flatnonzero(counts[p] < how.threshold), x, q, own.get(q_rows[p]), found, k)
                continue
            radius[p] = min(2 * radius[p], how.reach * kth[p] * (1 + 1e-6), widest)
            still.append(p)
        low[:, open_], high[:, open_] = new_low, new_high
        open_ = np.array(still, dtype=np.int64)
    out = []
    for p, (places, scores) in enumerate(found):
        ahead = how.distances(scores / norms[p]) <= bound[p] * (1 + 1e-9)  # what the first shard has beaten stays here
        out.append((q_rows[p], q_ids[p], kth[p], ids[places[ahead]], scores[ahead]))
    return out


def _verify(p: int, places: np.ndarray, x: np.ndarray, q: np.ndarray, own: int | None, found: list, k: int) -> None:
    """Adds the inner products of a query with vectors at some places of a shard, and keeps the k best. Places go by identifiers, so ties do."""
    if own is not None:
        places = places[places != own]
    if not len(places):
        return
    at = np.concatenate([found[p][0], places])
    scores = np.concatenate([found[p][1], (x[places] @ q[p])])
    if len(at) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9 * (np.abs(scores).max() + 1e-300)
        at = at[near]
    scores = (x[at] * q[p]).sum(1)  # row by row, so that equal vectors have equal scores
    order = np.lexsort((at, -scores))[:k]
    found[p] = at[order], scores[order]


def _searched(queries: DataFrame, shards: DataFrame, n_shards: list[int], blocks: int, how: Settings, k: int) -> DataFrame:
    """(row, query_id, bound, vec_id, score): what each query, in its block, finds in each of the shards."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _met(left, right, how, k) if len(left) and len(right) else []
        sizes = [len(r[3]) for r in out]
        flat = [np.repeat(np.array([r[i] for r in out]), sizes) for i in range(3)] + [np.concatenate([r[i] for r in out]) if out else [] for i in (3, 4)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(flat, kinds)], names=["row", "query_id", "bound", "vec_id", "score"])

    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.array(*map(F.lit, n_shards)) if len(n_shards) < 2 else F.sequence(F.lit(n_shards[0]), F.lit(n_shards[-1]))))
    both = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return both.applyInArrow(meet, "row bigint, query_id bigint, bound double, vec_id bigint, score double")


def search(
    vectors: DataFrame,
    wanted,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    **settings,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the condition `wanted` holds (over the column id), the k rows of the largest inner
    product found."""
    rows, dims, largest = usable(vectors, id, vector)
    empty = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    if not dims:
        return empty
    how = Settings(dims, largest, **settings)
    queries = rows.filter(wanted)
    blocks = -(-queries.count() // (block_queries * 9 // 10))
    if not blocks:
        return empty
    shards, n = index(rows, how, shard_rows)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("bound", F.lit(float("inf")))
    found = first = stored(_searched(queries, shards.filter("shard = 0"), [0], blocks, how, k), "first-shard")
    if n > 1:
        bounds = first.groupBy("row").agg(F.min("bound").alias("bound"))  # infinite where fewer than k were found
        bounded = queries.drop("bound").join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = first.unionByName(_searched(bounded, shards.filter("shard > 0"), list(range(1, n)), blocks, how, k))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    best = found.select("row", "query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
