"""Constrained nearest-neighbour joins.

`nearest` is the one primitive: the k best pool rows of each query among those that agree with it in the key columns.
Both sides of a key are cut into blocks of bounded size; a task scores one block of queries against one block of the pool
with one matrix product and sends k rows a query on. So a key that holds a third of all rows is spread over many tasks,
and no pair is ever a row. All retrievers are this, a ladder of keys, and a way to combine the neighbours.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators import blocks, sequence
from seqloom.operators.cluster import coarse_cells, probed
from seqloom.operators.sampling import draw, drawn
from seqloom.storage import new_path, stored

METRICS = ("cosine", "l2", "dot")
DIGITS = 6


def _scores(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer."""
    if metric == "dot":
        return -(q @ p.T)
    if metric == "cosine":
        return -(q @ p.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :], 1e-300)
    sizes = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :]
    squares = np.maximum(sizes - 2 * (q @ p.T), 0)
    close = np.flatnonzero(squares <= 1e-4 * sizes)  # what is left of two large numbers is exact to few digits: equal vectors must be 0 apart
    for at in np.array_split(close, -(-len(close) // 65_536) or 1):
        i, j = np.divmod(at, len(p)) if len(p) else (at, at)
        squares.ravel()[at] = ((q[i] - p[j]) ** 2).sum(1)
    return np.sqrt(squares)


def _blocks(df: DataFrame, keys: list[str], block_rows: int, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{name}_blocks"))


def nearest(
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
    cells: int = 0,
) -> DataFrame:
    """(query_id, rank from 1, pool_id, score): score is the similarity for cosine and dot and the distance for l2, rounded to six digits; ties go to
    the smaller id. cells: above 0, the same rows by a search that skips units of rows around so many centers (`pruned.search`)."""
    if metric not in METRICS:
        raise ValueError(metric)
    if cells:
        from seqloom.operators import pruned

        return pruned.search(queries, pool, keys, k, metric, query_id, pool_id, query_vector, pool_vector, exclude_self, block_rows, cells)[0]
    on = keys or ["__one"]
    same = [F.col(c).alias(c) for c in keys]  # new columns, for queries and pool may be one table
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), *same, F.col(query_vector).alias("v")).filter("v is not null")
    p = pool.select(F.col(pool_id).cast("bigint").alias("pool_id"), *same, F.col(pool_vector).alias("v")).filter("v is not null")
    if not keys:
        q, p = q.withColumn("__one", F.lit(1)), p.withColumn("__one", F.lit(1))
    q, p = blocks.alike(q, p, on)
    nq, np_ = _blocks(q, on, block_rows, "q"), _blocks(p, on, block_rows, "p")
    sizes = nq.join(np_, on)
    # a row goes to its own block and to each block of the other side; both numbers are ints on both sides, for an int and a bigint of one value go to
    # different partitions
    qs = q.join(sizes, on).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)))
    ps = p.join(sizes, on).withColumn("pb", F.pmod(F.xxhash64("pool_id"), F.col("p_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "pool_id": [], "score": []})
        right = right.sort_values("pool_id", kind="stable")
        a, b = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        ids, pool_ids = left["query_id"].to_numpy(), right["pool_id"].to_numpy()
        s = np.round(_scores(a, b, metric), DIGITS) + 0.0
        if exclude_self:
            s[ids[:, None] == pool_ids[None, :]] = np.inf
        best = np.argsort(s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "pool_id": pool_ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})
        return out[np.isfinite(out["score"])]

    by = [*on, "qb", "pb"]
    partial = qs.select(*by, "query_id", "v").groupBy(*by).cogroup(ps.select(*by, "pool_id", "v").groupBy(*by)).applyInPandas(score, "query_id bigint, pool_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "pool_id"))
    found = partial.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "pool_id", (F.col("score") if metric == "l2" else -F.col("score")).alias("score"))


def ladder(queries: DataFrame, pool: DataFrame, levels: list[list[str]], k: int, **how) -> DataFrame:
    """nearest at the first level whose keys the pool has for the query, with that level. Queries for which none has it are missing: the caller keeps
    them as they are."""
    left, out = queries, None
    for n, keys in enumerate(levels):
        have = pool.select(*keys).distinct() if keys else None
        now = left.join(have, keys, "left_semi") if keys else left
        some = nearest(now, pool, keys, k, **how).withColumn("level", F.lit(n))
        out = some if out is None else out.unionByName(some)
        if not keys:
            break
        left = left.join(have, keys, "left_anti")
    return out


def soft_levels(queries: DataFrame, pool: DataFrame, hard: list[str], soft: list[str], gate: int) -> DataFrame:
    """queries with mask, the soft keys that apply, as bits: in turn, each applies only if `gate` pool rows or more survive it on what the ones before
    left. A negative or null value of the query never applies."""
    out = queries.withColumn("mask", F.lit(0))
    for bit, column in enumerate(soft):
        parts = None
        for taken in range(1 << bit):
            keys = [*hard, *(c for b, c in enumerate(soft[:bit]) if taken >> b & 1), column]
            counts = pool.groupBy(*keys).agg(F.count("*").alias("__n"))
            some = out.filter(F.col("mask") == taken).join(counts, keys, "left")
            usable = F.col(column).isNotNull() & (F.coalesce(F.col(column).cast("bigint"), F.lit(-1)) >= 0)
            some = some.withColumn("mask", F.when(usable & (F.coalesce("__n", F.lit(0)) >= gate), F.lit(taken | 1 << bit)).otherwise(F.lit(taken))).drop("__n").select(*queries.columns, "mask")
            parts = some if parts is None else parts.unionByName(some)
        out = parts
    return out


def soft_nearest(queries: DataFrame, pool: DataFrame, hard: str | list[str], soft: list[str], k: int, gate: int | None = None, **how) -> DataFrame:
    """nearest with hard keys and soft ones, with the mask that applied. gate: pool rows that a soft key must leave to apply, k by default."""
    hard = [hard] if isinstance(hard, str) else hard
    masked, out = soft_levels(queries, pool, hard, soft, k if gate is None else gate), None
    for mask in range(1 << len(soft)):
        keys = [*hard, *(c for b, c in enumerate(soft) if mask >> b & 1)]
        some = nearest(masked.filter(F.col("mask") == mask), pool, keys, k, **how).withColumn("mask", F.lit(mask))
        out = some if out is None else out.unionByName(some)
    return out


def _per_query(neighbours: DataFrame, pool: DataFrame, weight: Column | None, dims: int, pool_id: str, pool_vector: str) -> DataFrame:
    rows = neighbours.join(pool.select(F.col(pool_id).cast("bigint").alias("pool_id"), F.col(pool_vector).alias("__v")), "pool_id")
    if weight is None:
        return rows.groupBy("query_id").agg(vec.mean_vector(F.col("__v"), dims).alias("vector"))
    rows = rows.withColumn("__w", weight)
    return rows.groupBy("query_id").agg(F.array(*(F.sum(F.col("__w") * F.col("__v")[i]) / F.sum("__w") for i in range(dims))).alias("vector"))


def mean_of(neighbours: DataFrame, pool: DataFrame, dims: int, pool_id: str = "frame_id", pool_vector: str = "feature") -> DataFrame:
    """(query_id, vector): the mean of the neighbours' vectors; pool_vector may be another layer than was searched."""
    return _per_query(neighbours, pool, None, dims, pool_id, pool_vector)


def softmax_of(
    neighbours: DataFrame,
    pool: DataFrame,
    dims: int,
    temperature: float = 1.0,
    distance: bool = False,
    pool_id: str = "frame_id",
    pool_vector: str = "feature",
) -> DataFrame:
    """The mean weighted by softmax(similarity / temperature), or of -distance**2 / temperature."""
    logit = (-F.col("score") * F.col("score") if distance else F.col("score")) / F.lit(temperature)
    top = F.max(logit).over(Window.partitionBy("query_id"))
    return _per_query(neighbours.withColumn("__e", F.exp(logit - top)), pool, F.col("__e"), dims, pool_id, pool_vector)


def skipped(neighbours: DataFrame, skip: int, least: int = 1) -> DataFrame:
    """The neighbours behind the nearest `skip`; of queries that then have fewer than least, all."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return neighbours.withColumn("__n", n).filter((F.col("rank") > skip) | (F.col("__n") < skip + least)).drop("__n")


def picked(neighbours: DataFrame, n: int, seed: int = 5, replace: bool = False) -> DataFrame:
    """n neighbours of each query drawn by MD5 of query and neighbour (or draw), without or with replacement (then in several rows)."""
    if not replace:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(drawn(seed, "query_id", "pool_id"), "pool_id"))
        return neighbours.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
    place = Window.partitionBy("query_id").orderBy("rank")
    numbered = neighbours.withColumns({"__i": F.row_number().over(place), "__n": F.count("*").over(Window.partitionBy("query_id"))})
    draws = numbered.groupBy("query_id").agg(F.max("__n").alias("__n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("__i", draw(seed, "query_id", "draw") % F.col("__n") + 1)
    return draws.drop("__n").join(numbered.drop("__n"), ["query_id", "__i"]).drop("__i")


def dirichlet_of(chosen: DataFrame, pool: DataFrame, dims: int, seed: int = 6, pool_id: str = "frame_id", pool_vector: str = "feature") -> DataFrame:
    """The mean weighted by Dirichlet(1): -ln(u), u by MD5 of query and draw."""
    u = (draw(seed, "query_id", "draw" if "draw" in chosen.columns else "rank") + 0.5) / F.lit(float(1 << 32))
    return _per_query(chosen.withColumn("__u", -F.log(u)), pool, F.col("__u"), dims, pool_id, pool_vector)


def kept_where_missing(combined: DataFrame, queries: DataFrame, query_id: str = "frame_id", vector: str = "feature") -> DataFrame:
    """(query_id, vector, found) of every query: its own vector where nothing was found."""
    own = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("__own"))
    return own.join(combined, "query_id", "left").select("query_id", F.coalesce("vector", "__own").alias("vector"), F.col("vector").isNotNull().alias("found"))


# The retrievers, by what they are made of.


def cluster_retriever(
    queries: DataFrame,
    centers: DataFrame,
    levels=(("phone", "gender"), ("phone",)),
    fallback: DataFrame | None = None,
    metric: str = "l2",
    k: int = 1,
    dims: int | None = None,
    **how,
) -> DataFrame:
    """(query_id, vector): the nearest center, or the mean of the k nearest (dims: theirs), at the first level that has one, else the query, or the
    fallback's rows (query_id, vector)."""
    found = ladder(queries, centers, [list(x) for x in levels], k, metric=metric, pool_id="center_id", pool_vector="center", **how)
    if k > 1:
        best = mean_of(found, centers, dims, "center_id", "center")
    else:
        best = found.join(centers.select(F.col("center_id").cast("bigint").alias("pool_id"), F.col("center").alias("vector")), "pool_id").select("query_id", "vector")
    if fallback is not None:
        best = best.unionByName(fallback.join(best, "query_id", "left_anti"))
    return kept_where_missing(best, queries, how.get("query_id", "frame_id"), how.get("query_vector", "feature"))


def constrained_retriever(
    queries: DataFrame,
    pool: DataFrame,
    dims: int,
    k: int = 4,
    temperature: float = 1.0,
    top1: bool = False,
    cosine: bool = True,
    hard: str = "gender",
    soft=("phone", "symbol"),
) -> DataFrame:
    """(query_id, vector, found): top-1, or the softmax of the k nearest, under one hard and several soft keys, which apply if they leave k rows or
    more in both cases."""
    soft = [c for c in soft if c in queries.columns and c in pool.columns]
    found = soft_nearest(queries, pool, hard, soft, 1 if top1 else k, k, metric="cosine" if cosine else "l2")
    return kept_where_missing(softmax_of(found, pool, dims, temperature, distance=not cosine), queries)


def _kept(queries: DataFrame, centers: DataFrame, *levels) -> DataFrame:
    """cluster_retriever's rows, stored, for what it found and what it didn't are both needed."""
    return stored(cluster_retriever(queries, centers, *levels), "found")


def dispatched(queries: DataFrame, pool: DataFrame, dims: int, centers: DataFrame | None = None, use_clusters: bool = True, use_symbols: bool = True, **how) -> DataFrame:
    """(query_id, vector, found): the nearest center of the query's phone, where centers are used and there is one; else the constrained neighbours,
    with symbols if asked for.

    With centers, queries whose phone has none go to the neighbours without symbols, and stay as they are if those fail too.
    """
    if centers is None or not use_clusters:
        return constrained_retriever(queries, pool, dims, soft=("phone", "symbol") if use_symbols else ("phone",), **how)
    found = _kept(queries, centers, [x for x in (("phone", "gender"), ("phone",)) if set(x) <= set(centers.columns)])
    rest = queries.join(found.filter("not found").select(F.col("query_id").alias("frame_id")), "frame_id", "left_semi")
    return found.filter("found").unionByName(constrained_retriever(rest, pool, dims, soft=("phone",), **how))


def quantized_retriever(queries: DataFrame, centers: DataFrame, pattern: int, gender: int, any_gender: int | None = 0) -> DataFrame:
    """(query_id, vector, found): the nearest center of (pattern, phone, gender), else of (pattern, phone, any_gender), else the query. any_gender
    None leaves the middle step out."""
    aimed = queries.withColumns({"pattern": F.lit(pattern), "gender": F.lit(gender)})
    found = _kept(aimed, centers, (("pattern", "phone", "gender"),))
    if any_gender is None or any_gender == gender:
        return found
    rest = queries.join(found.filter("not found").select(F.col("query_id").alias("frame_id")), "frame_id", "left_semi").withColumns({"pattern": F.lit(pattern), "gender": F.lit(any_gender)})
    return found.filter("found").unionByName(cluster_retriever(rest, centers, (("pattern", "phone", "gender"),)))


def speaker_retriever(queries: DataFrame, frames: DataFrame, speaker) -> DataFrame:
    """(query_id, vector, found): the target speaker's frame of the query's phone that is nearest in cosine, else the query."""
    target = queries.withColumn("speaker", F.lit(speaker).cast(dict(frames.dtypes)["speaker"]))
    return _one(nearest(target, frames, ["speaker", "phone"], 1), queries, frames)


def gender_retriever(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """(query_id, vector, found): the frame nearest in cosine among those of the gender, else among all."""
    return _one(ladder(queries, frames, [["gender"], []], 1), queries, frames)


def _one(found: DataFrame, queries: DataFrame, frames: DataFrame) -> DataFrame:
    own = frames.select(F.col("frame_id").cast("bigint").alias("pool_id"), F.col("feature").alias("vector"))
    return kept_where_missing(found.join(own, "pool_id").select("query_id", "vector"), queries)


def utterance_retriever(queries: DataFrame, frames: DataFrame, chosen: DataFrame, dims: int, k: int = 4, constrained: bool = True) -> DataFrame:
    """(query_id, vector, found): the mean of the k frames nearest in cosine out of the target utterance, of the query's phone or, unconstrained, of
    any; else the query. chosen: (utt, target_utt)."""
    to = queries.join(chosen, "utt").drop("utt").withColumnRenamed("target_utt", "utt")
    return kept_where_missing(mean_of(nearest(to, frames, ["utt", "phone"] if constrained else ["utt"], k), frames, dims), queries)


def utterance_cluster_retriever(queries: DataFrame, centers: DataFrame, chosen: DataFrame, dims: int, k: int = 1) -> DataFrame:
    """(query_id, vector, found): the nearest in cosine, or the mean of the k nearest, of the target utterance's centers of the phone; else the query.
    centers: (utt, phone, center_id, center)."""
    to = queries.join(chosen, "utt", "left").drop("utt").withColumnRenamed("target_utt", "utt")
    return cluster_retriever(to, centers, (("utt", "phone"),), metric="cosine", k=k, dims=dims)


def bank_retriever(queries: DataFrame, bank: DataFrame, dims: int, k: int = 4, search: str = "feature", give: str = "feature", key: str = "phone") -> DataFrame:
    """(query_id, vector, found): the mean of the k nearest rows of the query's phone, else of the whole bank; searched in one layer, given from another."""
    found = ladder(queries, bank, [[key], []], k, metric="l2", query_vector=search, pool_vector=search)
    return kept_where_missing(mean_of(found, bank, dims, pool_vector=give), queries, vector=search)


def multi_pool_retriever(queries: DataFrame, bank: DataFrame, dims: int, nearest_k: int = 20, pick: int = 5, seed: int = 5) -> DataFrame:
    """The mean of `pick` rows drawn from the nearest_k of the phone, else of all."""
    found = ladder(queries, bank, [["phone"], []], nearest_k, metric="l2")
    return kept_where_missing(mean_of(picked(found, pick, seed), bank, dims), queries)


def pseudo_retriever(queries: DataFrame, bank: DataFrame, dims: int, skip: int = 3, among: int = 20, k: int = 4, seed: int = 5) -> DataFrame:
    """Skips the nearest, draws k of those behind with replacement, and weighs them by Dirichlet(1); with too few, the mean of the nearest."""
    found = stored(ladder(queries, bank, [["phone"], []], skip + among, metric="l2"), "found")  # it is read three times
    n = F.count("*").over(Window.partitionBy("query_id"))
    sized = found.withColumn("__n", n)
    many = dirichlet_of(picked(sized.filter((F.col("__n") > skip) & (F.col("rank") > skip)).drop("__n"), k, seed, replace=True), bank, dims)
    few = mean_of(sized.filter((F.col("__n") <= skip) & (F.col("rank") <= k)).drop("__n"), bank, dims)
    return kept_where_missing(many.unionByName(few), queries)


def adain_retriever(queries: DataFrame, bank: DataFrame, dims: int, k: int = 4, search: str = "feature", give: str = "feature") -> DataFrame:
    """The bank's mean with the statistics of the query over its dimensions; searched by one layer, such as an encoder's codes, given from another."""
    found = bank_retriever(queries, bank, dims, k, search, give)
    own = queries.select(F.col("frame_id").cast("bigint").alias("query_id"), F.col(give).alias("__own"))
    return found.join(own, "query_id").select("query_id", F.when(F.col("found"), vec.adain(F.col("vector"), F.col("__own"))).otherwise(F.col("__own")).alias("vector"), "found")


def target_speaker(pool: DataFrame, mode: str = "random", gender=None, fixed=None, seed: int = 9):
    """The speaker to aim at: a fixed one, one drawn among those of the gender (among all if there is none), or None for the whole pool. One row comes
    to the driver."""
    if mode == "fixed":
        return fixed
    if mode == "pool":
        return None
    if mode != "random":
        raise ValueError(mode)
    speakers = pool.groupBy("speaker").agg(F.min("gender").alias("gender"))
    fits = F.col("gender").eqNullSafe(F.lit(gender)) if gender is not None else F.lit(True)
    row = speakers.select("speaker", fits.alias("fits"), drawn(seed, "speaker").alias("d")).orderBy(F.desc("fits"), "d", "speaker").limit(1).collect()
    return row[0]["speaker"] if row else None


def prototype_retriever(
    queries: DataFrame,
    pool: DataFrame,
    dims: int,
    speaker=None,
    gender: int | None = None,
    k: int = 4,
    temperature: float = 1.0,
    centers: DataFrame | None = None,
) -> DataFrame:
    """(query_id, vector, found): with centers, the nearest of (phone, gender), then of the phone. Else the softmax of -distance**2 over the prototypes of
    speaker and gender (either may be None), by phone where k survive; where speaker and gender have none, over those of the gender; else the query.
    pool: frame_id, speaker, gender, phone, feature."""
    if centers is not None:
        aimed = queries if gender is None else queries.withColumn("gender", F.lit(gender).cast(dict(centers.dtypes)["gender"]))
        found = _kept(aimed, centers)
        rest = queries.join(found.filter("not found").select(F.col("query_id").alias("frame_id")), "frame_id", "left_semi")
        return found.filter("found").unionByName(prototype_retriever(rest, pool, dims, speaker, gender, k, temperature))
    kinds = dict(pool.dtypes)
    aims = {c: F.lit(v).cast(kinds[c]) for c, v in (("speaker", speaker), ("gender", gender)) if v is not None}
    if not aims:
        aims, pool = {"__any": F.lit(1)}, pool.withColumn("__any", F.lit(1))
    target = queries.withColumns(aims)
    found = soft_nearest(target, pool, list(aims), ["phone"], k, metric="l2")
    if speaker is not None and gender is not None:
        rest = target.join(found.select(F.col("query_id").alias("frame_id")).distinct(), "frame_id", "left_anti")
        found = found.drop("mask").unionByName(nearest(rest, pool, ["gender"], k, metric="l2"))
    return kept_where_missing(softmax_of(found, pool, dims, temperature, distance=True), queries)


def select_style(queries: DataFrame, styles: DataFrame, **how) -> DataFrame:
    """(query_id, pool_id, score, level): the style nearest in cosine among those of the gender, else among all."""
    return ladder(queries, styles, [["gender"], []], 1, metric="cosine", **how).drop("rank")


def style_retriever(queries: DataFrame, frames: DataFrame, chosen: DataFrame, dims: int, k: int = 4, silence=(0,), sharpness: float = 10.0) -> DataFrame:
    """queries (frame_id, utt, phone, feature); chosen (utt, target_utt). Frames of the target utterance and phone, else of the phone anywhere;
    silence is copied."""
    to = queries.filter(~F.col("phone").isin(list(silence))).join(chosen, "utt").drop("utt").withColumnRenamed("target_utt", "utt")
    found = ladder(to, frames, [["utt", "phone"], ["phone"]], k, metric="cosine")
    return kept_where_missing(softmax_of(found, frames, dims, 1 / sharpness), queries)


def reconstruction_error(frames: DataFrame, centers: DataFrame, key: str = "phone") -> DataFrame:
    """(mse, mae, mean_distance) of each frame and the nearest center of its phone; a frame without one counts as itself."""
    found = nearest(frames, centers, [key], 1, metric="l2", pool_id="center_id", pool_vector="center")
    best = found.join(centers.select(F.col("center_id").cast("bigint").alias("pool_id"), "center"), "pool_id").select(F.col("query_id").alias("frame_id"), "center")
    both = frames.join(best, "frame_id", "left").withColumn("c", F.coalesce("center", "feature"))
    diff = F.zip_with("feature", "c", lambda x, y: x - y)
    return both.agg(F.avg(vec.total(F.transform(diff, lambda x: x * x)) / F.size("feature")).alias("mse"), F.avg(vec.total(F.transform(diff, F.abs)) / F.size("feature")).alias("mae"), F.avg(vec.l2(F.col("feature"), F.col("c"))).alias("mean_distance"))


def window_blend(content: Column, style: Column, alpha: float) -> Column:
    return F.zip_with(content, style, lambda c, s: (1 - alpha) * c + alpha * s)


def content_vectors(rows: DataFrame, key: str, phones: list, style: str | None = None, phone: str = "phone", weight: float = 0.4, presence: bool = False) -> DataFrame:
    """(key, v): the shares of the phones among the key's rows (presence: 1 for each phone that occurs) times 1 - weight (presence: 1), and behind them
    the unit style vector, if there is one, times weight (presence: 1), so that v . v' of a source and a window is the blend of the share of the
    source's rows whose phone occurs in the window and the cosine of their styles."""
    counts = [F.count_if(F.col(phone) == F.lit(x)) for x in phones]
    part = [F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0)) for c in counts] if presence else [F.lit(1 - weight) * c / F.count("*") for c in counts]
    out = rows.groupBy(key).agg(F.array(*part).alias("__c"), *([F.first(style).alias("__s")] if style else []))
    if not style:
        return out.select(key, F.col("__c").alias("v"))
    scale = F.lit(1.0 if presence else weight) / F.greatest(vec.norm(F.col("__s")), F.lit(1e-300))
    return out.select(key, F.concat("__c", vec.scaled(F.col("__s"), scale)).alias("v"))


def window_matches(
    sources: DataFrame,
    windows: DataFrame,
    source_key: str,
    window_key: str,
    phones: list,
    style: str = "style",
    weight: float = 0.4,
    k: int = 1,
    levels=((),),
    **how,
) -> DataFrame:
    """(query_id, rank, pool_id, score, level): the k windows of the greatest (1 - weight) * content + weight * cosine of the styles.

    content: the share of the source's rows whose phone occurs in the window. sources, windows: a row a frame, with key, phone, style and
    the columns that levels name, equal within a key. Blocks of sources meet blocks of windows in one matrix product, so no pair is a row.
    """
    own = sorted({c for level in levels for c in level})
    sides = []
    for rows, key, presence in ((sources, source_key, False), (windows, window_key, True)):
        v = content_vectors(rows, key, phones, style, weight=weight, presence=presence)
        sides.append(stored(v.join(rows.select(key, *own).distinct(), key) if own else v, "content"))
    return ladder(sides[0], sides[1], [list(x) for x in levels], k, metric="dot", query_id=source_key, pool_id=window_key, query_vector="v", pool_vector="v", **how)


def window_retriever(sources: DataFrame, windows: DataFrame, phones: list, weight: float = 0.2, silence=(0,), key: str = "win") -> DataFrame:
    """(win, i, feature): each source window's frames replaced by those of the window that blends best, of the same dominant phone if one has it, else
    of any, stretched linearly to the source's length.

    Both tables have a row a frame: win (a whole number), t, phone, feature, style. Without windows, sources stay.
    """
    sides = [rows.join(sequence.dominant(rows, key, "phone", list(silence)), key, "left").withColumn("dominant", F.coalesce("dominant", F.lit(silence[0]))) for rows in (sources, windows)]
    found = window_matches(*sides, key, key, phones, weight=weight, levels=(("dominant",), ()))
    lengths = sources.groupBy(F.col(key).alias("query_id")).agg(F.count("*").alias("m"))
    pairs = found.select("query_id", F.col("pool_id").alias(key)).join(lengths, "query_id")
    given = windows.select(key, "t", "feature").join(pairs, key).drop(key).withColumnRenamed("query_id", key)
    out = sequence.resample_linear(given, key, ["t"], "feature", "m")
    rest = sequence.positioned(sources.join(pairs.select(F.col("query_id").alias(key)), key, "left_anti").select(key, "t", "feature"), key, ["t"])
    return out.unionByName(rest.select(key, F.col("pos").alias("i"), "feature"))


# Searches through coarse cells: fewer rows are compared, at the price of recall, which `recall` measures against the exact search.


def cell_index(pool: DataFrame, cells: int, vector: str = "feature", id: str = "frame_id") -> tuple[DataFrame, np.ndarray]:
    """An inverted file: the stored pool with cell, and the cells' centers. Every row is in it."""
    rows, centers = coarse_cells(pool, cells, vector, id)
    return stored(rows, "cells"), centers


def nearest_in_cells(queries: DataFrame, index: tuple[DataFrame, np.ndarray], keys: list[str], k: int, probes: int, query_vector: str = "feature", **how) -> DataFrame:
    """nearest, over the `probes` cells whose centers are nearest to the query; with as many probes as cells it is exact."""
    pool, centers = index
    return nearest(probed(queries, centers, probes, query_vector), pool, [*keys, "cell"], k, query_vector=query_vector, **how)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall,): the share of the exact neighbours that were found."""
    met = exact.select("query_id", "pool_id").join(found.select("query_id", "pool_id", F.lit(1).alias("hit")), ["query_id", "pool_id"], "left")
    return met.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def probes_for(queries: DataFrame, index: tuple[DataFrame, np.ndarray], exact: DataFrame, target: float = 0.9, id: str = "frame_id", vector: str = "feature") -> int:
    """The fewest probes by which the share `target` of the exact neighbours (query_id, pool_id) is found: in which of a query's cells they lie."""
    pool, centers = index
    cells = probed(queries.select(F.col(id).alias("query_id"), vector), centers, len(centers), vector)
    nearer = F.row_number().over(Window.partitionBy("query_id").orderBy("__i"))
    order = cells.withColumn("__i", F.monotonically_increasing_id()).select("query_id", "cell", nearer.alias("order"))
    placed = exact.join(pool.select(F.col(id).alias("pool_id"), "cell"), "pool_id").join(order, ["query_id", "cell"])
    found = {r["order"]: r["n"] for r in placed.groupBy("order").agg(F.count("*").alias("n")).collect()}  # a row for each number of cells
    share = np.cumsum([found.get(i, 0) for i in range(1, len(centers) + 1)]) / max(sum(found.values()), 1)
    return int(np.argmax(share >= target)) + 1


def coarse_style_search(
    queries: DataFrame,
    styles: DataFrame,
    cells: int = 256,
    probes: int | None = None,
    k: int = 1,
    keys=("gender",),
    query_id: str = "utt",
    pool_id: str = "utt",
    target: float = 0.9,
    exclude_self: bool = False,
) -> DataFrame:
    """(query_id, rank, pool_id, score): the styles nearest in cosine out of the nearest clusters of styles, of the same gender. Without probes, as many
    clusters as it takes to find the share `target` of the exact neighbours of a sample of the queries."""
    from seqloom.operators import ivf

    ivf.save(styles, path := new_path(styles.sparkSession, "styles"), list(keys), cells, flat_below=1, id=pool_id)
    index = ivf.load(styles.sparkSession, path)
    if probes is None:
        probes = ivf.probes_for(index, queries, k, target, query_id=query_id, exclude_self=exclude_self)
    return ivf.search(index, queries, k, probes, query_id, metric="cosine", exclude_self=exclude_self)


#: The retrievers by name, as `retriever` gives them.
RETRIEVERS = {
    "clusters": cluster_retriever,
    "constrained": constrained_retriever,
    "dispatched": dispatched,
    "quantized": quantized_retriever,
    "prototype": prototype_retriever,
    "bank": bank_retriever,
    "multi_pool": multi_pool_retriever,
    "pseudo": pseudo_retriever,
    "purified": adain_retriever,
    "style": style_retriever,
    "utterance": utterance_retriever,
    "utterance_clusters": utterance_cluster_retriever,
    "speaker": speaker_retriever,
    "gender": gender_retriever,
    "window": window_retriever,
}


def retriever(kind: str, **settings):
    """A retriever with its settings: retriever('bank', dims=64, k=4)(queries, bank). A pool's kind, frame_level or speaker_prototype, names one too."""
    name = {"frame_level": "constrained", "speaker_prototype": "prototype"}.get(kind, kind)
    if name not in RETRIEVERS:
        raise ValueError(f"{kind} is none of {sorted(RETRIEVERS)}")
    return partial(RETRIEVERS[name], **settings)
