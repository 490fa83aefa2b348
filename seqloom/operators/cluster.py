"""Vector quantisation, k-means with reproducible centers, and banks of representative frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import vec
from seqloom.operators import blocks, metrics, sampling, stats
from seqloom.operators.linalg import _matrix, _summed
from seqloom.storage import positioned, stored

#: Rows that one group's k-means is fitted on in a single task; larger groups are fitted by distributed steps.
GROUP_ROWS = 50_000


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first of the nearest centers, distances rounded to nine digits."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    return np.round(d, 9).argmin(1)


def encode(df: DataFrame, centers: np.ndarray, vector: str = "feature", out: str = "code") -> DataFrame:
    """df with the number of the nearest center. The codebook (codes x dims) is broadcast; its size is set when it is trained."""
    shared = df.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(x.to_numpy()).astype(np.float64), shared.value) if len(x) else [], dtype="int32")

    return df.withColumn(out, code(F.col(vector).cast("array<double>")))


def decode(df: DataFrame, centers: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    table = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], f"`{code}` int, `{out}` array<double>")
    return df.join(F.broadcast(table), code, "left")


def lloyd_step(df: DataFrame, centers: np.ndarray, vector: str = "feature") -> np.ndarray:
    """New centers from one pass: sums are made on the executors. A center without rows stays."""
    k, dims = centers.shape

    def partial(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        code = _nearest(x, centers)
        sums = np.zeros((k, dims))
        np.add.at(sums, code, x)
        return np.concatenate([np.bincount(code, minlength=k).astype(np.float64), sums.ravel()])

    total = _summed(df.select(F.col(vector).cast("array<double>")), partial, k * (dims + 1))
    n, sums = total[:k], total[k:].reshape(k, dims)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)


def codebook(df: DataFrame, k: int, vector: str = "feature", id: str = "frame_id", steps: int = 20) -> np.ndarray:
    """k-means over all rows from the vectors of the k smallest ids, in distributed steps until nothing moves by more than 1e-9."""
    first = df.orderBy(id).limit(k).select(F.col(vector).cast("array<double>")).collect()
    centers = np.array([r[0] for r in first], dtype=np.float64)
    for _ in range(steps):
        new = lloyd_step(df, centers, vector)
        if np.abs(new - centers).max(initial=0) < 1e-9:
            return new
        centers = new
    return centers


def _kmeans(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Rows come ordered by id; centers begin at evenly spaced ones."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        code = _nearest(x, centers)
        n = np.bincount(code, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, code, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if np.abs(new - centers).max() < 1e-9:
            break
        centers = new
    return centers


def _large_groups(rows: DataFrame, keys: list[str], sizes: DataFrame, fit_rows: int) -> tuple[list, DataFrame, DataFrame]:
    """The groups of more than fit_rows rows as (keys, n and what else sizes has), the rows of all others, and the large groups' rows with __g, the
    group's place in the list.

    There is one large group for fit_rows rows of the table at most; the list of them comes to the driver.
    """
    found = sizes.filter(F.col("n") > fit_rows).collect()
    if not found:
        return [], rows, rows.limit(0).withColumn("__g", F.lit(0))
    schema = T.StructType([T.StructField(f"__k{i}", rows.schema[c].dataType) for i, c in enumerate(keys)] + [T.StructField("__g", T.IntegerType())])
    numbers = F.broadcast(rows.sparkSession.createDataFrame([(*(r[c] for c in keys), g) for g, r in enumerate(found)], schema))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)))
    return found, rows.join(numbers, same, "left_anti"), rows.join(numbers, same).drop(*schema.names[:-1])


def _large_kmeans(rows: DataFrame, sizes: dict[int, tuple[int, int]], steps: int) -> dict[int, np.ndarray]:
    """_kmeans of whole groups by distributed steps: the centers of each group. rows: (__g, __id, __v); sizes: its rows and its centers.

    Sums by group and code are made on the executors. A group ends where it doesn't move any more. What comes to the
    driver and is broadcast are the centers of the large groups. They agree with _kmeans but for the rounding of sums.
    """
    spark = rows.sparkSession
    starts = {g: np.linspace(0, n - 1, k).astype(int) for g, (n, k) in sizes.items()}
    places = spark.createDataFrame([(g, int(p)) for g, ps in starts.items() for p in sorted(set(ps))], "__g int, pos bigint")
    first = positioned(rows.select("__g", "__id"), "__g", ["__id"]).join(F.broadcast(places), ["__g", "pos"])
    found = rows.join(F.broadcast(first), ["__g", "__id"]).groupBy("__g", "pos").agg(F.first("__v")).collect()
    at = {(g, p): np.array(v, dtype=np.float64) for g, p, v in found}
    centers = {g: np.stack([at[g, int(p)] for p in ps]) for g, ps in starts.items()}
    active = dict(centers)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(active)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                group, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for g in np.unique(group).tolist():
                    if g not in shared.value:
                        continue
                    c, own = shared.value[g], x[group == g]
                    code = _nearest(own, c)
                    sums = np.zeros((len(c), c.shape[1] + 1))
                    np.add.at(sums[:, 1:], code, own)
                    sums[:, 0] = np.bincount(code, minlength=len(c))
                    total[g] = total.get(g, 0) + sums
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["__g", "sums"])

        def add(t: pa.Table) -> pa.Table:
            x = sum(np.frombuffer(v, np.float64) for v in t.column("sums").to_pylist())
            return pa.table([t.column("__g").slice(0, 1), pa.array([x.tobytes()], pa.binary())], names=["__g", "sums"])

        moved = {}
        for g, raw in rows.select("__g", "__v").mapInArrow(partial, "__g int, sums binary").groupBy("__g").applyInArrow(add, "__g int, sums binary").collect():
            c = active[g]
            sums = np.frombuffer(raw, np.float64).reshape(len(c), -1)
            new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), c)
            if np.abs(new - c).max() >= 1e-9:
                moved[g] = centers[g] = new
        shared.unpersist()
        active = moved
        if not active:
            break
    return centers


def group_centers(
    df: DataFrame,
    keys: list[str],
    k: int,
    vector: str = "feature",
    id: str = "frame_id",
    steps: int = 20,
    least: int | None = None,
    few: str = "skip",
    fit_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(keys, center_id, center, n): k-means in each group of at least `least` rows (k by default). few: 'skip' smaller groups, give their rows 'raw',
    or 'shrink' k to half their rows, or take the 'sqrt' of their number, k at most.

    All rows of a group count. A group of up to fit_rows rows is fitted in one task, a larger one by distributed steps.
    """
    least = (1 if few == "sqrt" else k) if least is None else least

    def centers_of(n: int) -> int:
        return min(k, {"shrink": n // 2, "sqrt": isqrt(n)}.get(few, k))

    rows = df.select(*keys, F.col(id).cast("bigint").alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    kinds = dict(df.dtypes)
    large, rows, whole = _large_groups(rows, keys, rows.groupBy(*keys).agg(F.count("*").alias("n")), fit_rows)

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("__id")
        x = blocks.matrix(t, "__v")
        size = centers_of(len(x))
        if len(x) < least or size < 1:
            centers = x if few == "raw" else x[:0]
        else:
            centers = _kmeans(x, size, steps)
        own = [pa.array([t.column(c)[0].as_py()] * len(centers), t.schema.field(c).type) for c in keys]
        found = [pa.array(range(len(centers)), pa.int32()), pa.array(centers.tolist(), pa.list_(pa.float64())), pa.array([len(x)] * len(centers), pa.int64())]
        return pa.table([*own, *found], names=[*keys, "center_no", "center", "n"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "center_no int, center array<double>, n bigint"])
    out = rows.groupBy(*keys).applyInArrow(fit, schema)
    if not large:
        return out
    whole = stored(whole, "large-groups")
    count = {g: (r["n"], centers_of(r["n"])) for g, r in enumerate(large)}
    fitted = {g: (n, size) for g, (n, size) in count.items() if n >= least and size > 0}
    if few == "raw" and len(fitted) < len(large):
        raw = positioned(whole.filter(~F.col("__g").isin(list(fitted))), "__g", ["__id"])
        sizes = df.sparkSession.createDataFrame([(g, n) for g, (n, _) in count.items()], "__g int, n bigint")
        out = out.unionByName(raw.join(F.broadcast(sizes), "__g").select(*keys, F.col("pos").cast("int").alias("center_no"), F.col("__v").alias("center"), "n"))
    if not fitted:
        return out
    centers = _large_kmeans(whole, fitted, steps)
    return out.unionByName(df.sparkSession.createDataFrame([(*(large[g][c] for c in keys), i, [float(v) for v in x], large[g]["n"]) for g, found in centers.items() for i, x in enumerate(found)], out.schema))


def numbered(centers: DataFrame, keys: list[str]) -> DataFrame:
    """centers with center_id, unique over all groups, from the group's hash and the number in it."""
    return centers.withColumn("center_id", F.xxhash64(*keys, "center_no"))


def assigned(df: DataFrame, centers: DataFrame, keys: list[str], vector: str = "feature", id: str = "frame_id") -> DataFrame:
    """df with center_no and distance of the nearest center of its group, of equally near ones the first; a block of rows meets its group's centers in
    one matrix product."""

    def work(rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("center_no")
        d = np.round(blocks.squared_distances(blocks.matrix(rows, vector), blocks.matrix(own, "center")), 9)
        best = d.argmin(1)
        return rows.append_column("center_no", own.column("center_no").take(pa.array(best))).append_column("distance", pa.array(np.sqrt(d[np.arange(len(d)), best])))

    schema = T.StructType([*df.schema.fields, T.StructField("center_no", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    return blocks.met(df, centers.select(*keys, F.col("center_no").cast("int").alias("center_no"), "center"), keys, work, schema, id)


def bank(
    df: DataFrame,
    dims: int,
    clusters: int = 8,
    per_cluster: int = 20,
    least_speakers: int = 3,
    silence=(0,),
    search: str = "feature",
    entropy_top: float | None = None,
    fallback: bool = True,
) -> DataFrame:
    """The frames of a bank: per phone, clusters of the search layer; those with enough speakers (and, if asked, entropy in the top share); of each
    the frames nearest its center. Phones of which no cluster passes give all their frames, if fallback.

    Clusters are chosen on the search layer alone; further columns are read for the chosen frames only, by the join on frame_id.
    """
    slim = df.filter(~F.col("phone").isin(list(silence))).select("frame_id", "phone", "speaker", F.col(search).alias("feature"))
    centers = group_centers(slim, ["phone"], clusters, least=1, few="shrink") if entropy_top is not None else group_centers(slim, ["phone"], clusters)
    rows = stored(assigned(slim, centers, ["phone"]).drop("feature"), "assigned")
    good = stats.diverse(rows, ["phone", "center_no"], least=least_speakers)
    if entropy_top is not None:
        full = good.join(slim.select("frame_id", "feature"), "frame_id").withColumn("cluster", F.concat_ws("/", "phone", "center_no"))
        top = full.select("phone", "cluster").distinct().join(stats.cluster_entropy(full, dims), "cluster")
        edge = top.groupBy("phone").agg(F.percentile("entropy", 1 - entropy_top).alias("edge"))
        keep = top.join(edge, "phone").filter("entropy >= edge").select("cluster")
        good = good.join(keep, F.concat_ws("/", "phone", "center_no") == F.col("cluster"), "left_semi")
    chosen = stats.nearest_to_center(good, ["phone", "center_no"], per_cluster).select("frame_id", "center_no", "rank")
    out = df.join(chosen, "frame_id")
    if not fallback:
        return out
    rest = df.filter(~F.col("phone").isin(list(silence))).join(out.select("phone").distinct(), "phone", "left_anti")
    return out.unionByName(rest.withColumns({"center_no": F.lit(None).cast("int"), "rank": F.lit(None).cast("int")}))


def sub_clustered(bank_rows: DataFrame, dims: int, sub: int = 4, search: str = "feature", give: str = "feature") -> DataFrame:
    """(phone, center_no, sub_no, centroid, mean): a second level of k-means within each cluster of a bank; the centroid of the search layer and the
    mean of another."""
    some = bank_rows.filter("center_no is not null")
    inner = some.select("frame_id", "phone", F.col("center_no").alias("outer_no"), F.col(search).alias("feature"), F.col(give).alias("given"))
    centers = group_centers(inner, ["phone", "outer_no"], sub, least=1, few="shrink")
    rows = assigned(inner, centers, ["phone", "outer_no"]).groupBy("phone", F.col("outer_no").alias("center_no"), F.col("center_no").alias("sub_no"))
    return rows.agg(vec.mean_vector(F.col("feature"), dims).alias("centroid"), vec.mean_vector(F.col("given"), dims).alias("mean"))


def pseudo_bank(
    df: DataFrame,
    entropies: DataFrame,
    dims: int,
    clusters: int = 50,
    per_cluster: int = 20,
    percentile: float = 60,
    least_speakers: int = 3,
    silence=(0,),
) -> DataFrame:
    """A bank of the frames whose confusion entropy is at or over their phone's percentile."""
    confused = stats.over_percentile(entropies.select("frame_id", "phone", "entropy"), ["phone"], "entropy", percentile / 100)
    return bank(df.join(confused.select("frame_id"), "frame_id", "left_semi"), dims, clusters, per_cluster, least_speakers, silence)


def purified_bank(df: DataFrame, encode: Callable[[np.ndarray], np.ndarray], dims: int, vector: str = "feature", out: str = "encoded", **how) -> DataFrame:
    """A bank whose clusters are those of an encoder's output: df with `out`, rows chosen by it. encode: a matrix of vectors to one of codes, such as
    a model's; dims: of the codes. An encoder that must be loaded comes by `purified_bank_by`."""
    return purified_bank_by(df, lambda: encode, dims, vector, out, **how)


def purified_bank_by(df: DataFrame, load: Callable[[], Callable], dims: int, vector: str = "feature", out: str = "encoded", **how) -> DataFrame:
    """purified_bank by an encoder that load makes, once a worker."""
    from seqloom.functions.predict import with_layers

    def model():
        encode = load()
        return lambda x: {"codes": np.asarray(encode(x), dtype=np.float64)}

    coded = with_layers(df, model, {"codes": "array<double>"}, vector, "__layers")
    return bank(stored(coded.withColumn(out, F.col("__layers.codes")).drop("__layers"), "encoded"), dims, search=out, **how)


def quantized_pool(df: DataFrame, most: int = 64, least: int = 100) -> DataFrame:
    """(pattern, phone, gender, center_no, center, n): k = min(most, n / 2) centers of each group of at least `least` rows."""
    return group_centers(df, ["pattern", "phone", "gender"], most, least=least, few="shrink")


def skipped_groups(df: DataFrame, least: int = 100, keys=("pattern", "phone", "gender")) -> DataFrame:
    """(groups, skipped, rows_skipped): how many groups a quantized pool leaves out for having too few rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    few = F.col("n") < least
    return n.agg(F.count("*").alias("groups"), F.count_if(few).alias("skipped"), F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)).alias("rows_skipped"))


def prototypes(df: DataFrame, budget: int, dims: int, by_phone: bool = True, fit_rows: int = GROUP_ROWS) -> DataFrame:
    """(speaker, phone, center_no, center): unit-length prototypes, `budget` of a speaker, or as many as it has rows. by_phone: the budget is
    shared out by prototype_budget; a phone that gets none of it has no prototypes, and one with fewer rows than its part gives its rows.

    All rows of a group count. A group of up to fit_rows rows is fitted in one task, a larger one by distributed steps.
    """
    keys = ["speaker", "phone"] if by_phone else ["speaker"]
    sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    if by_phone:
        share = sampling.prototype_budget(sizes, "phone", budget, "speaker").filter("keep > 0")
        want = sizes.join(share, keys).select(*keys, "n", F.col("keep").cast("int").alias("want"))
    else:
        want = sizes.withColumn("want", F.lit(budget))
    want = stored(want, "budgets")
    large, rows, whole = _large_groups(df.select(*keys, "frame_id", "feature"), keys, want, fit_rows)
    rows = rows.join(want.drop("n"), keys)
    kinds = dict(df.dtypes)
    unit = lambda c: c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-8)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        c = _kmeans(np.stack(pdf["feature"].to_numpy()), min(int(pdf["want"].iloc[0]), len(pdf)), 20)
        c = unit(c)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(c) for k in keys}).assign(center_no=np.arange(len(c), dtype="int32"), center=[x.tolist() for x in c])

    out = rows.groupBy(*keys).applyInPandas(fit, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "center_no int, center array<double>"]))
    if not large:
        return out
    whole = stored(whole.select("__g", F.col("frame_id").cast("bigint").alias("__id"), F.col("feature").cast("array<double>").alias("__v")), "large-groups")
    centers = _large_kmeans(whole, {g: (r["n"], min(r["want"], r["n"])) for g, r in enumerate(large)}, 20)
    return out.unionByName(df.sparkSession.createDataFrame([(*(large[g][k] for k in keys), i, [float(v) for v in x]) for g, c in centers.items() for i, x in enumerate(unit(c))], out.schema))


def coarse_cells(df: DataFrame, cells: int, vector: str = "feature", id: str = "frame_id") -> tuple[DataFrame, np.ndarray]:
    """An inverted-file index: df with cell, and the cells' centers; queries then look into the cells nearest to them."""
    centers = codebook(df, cells, vector, id)
    return encode(df, centers, vector, "cell"), centers


def probed(queries: DataFrame, centers: np.ndarray, probes: int, vector: str = "feature") -> DataFrame:
    """queries, a row for each of the `probes` nearest cells, as cell."""
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def cells(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        q, c = np.stack(x.to_numpy()).astype(np.float64), shared.value
        d = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)
        return pd.Series(list(np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :probes].astype("int32")))

    return queries.withColumn("cell", F.explode(cells(F.col(vector).cast("array<double>"))))


def codebook_quality(codes: DataFrame, k: int, code: str = "code") -> DataFrame:
    """(active, entropy_bits): codes that more than one row in a hundred has, and the entropy of the codes."""
    counts = codes.groupBy(code).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return counts.agg(F.count_if(F.col("p") > 0.01).alias("active"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"))


def codebooks(df: DataFrame, ks, vector: str = "feature", id: str = "frame_id", steps: int = 20) -> dict[int, np.ndarray]:
    """`codebook` for each k, all of them stepped in one pass over the rows: as many passes as steps. What a pass sends is numbers by (k, code)."""
    first = df.orderBy(id).limit(max(ks)).select(F.col(vector).cast("array<double>")).collect()
    start = np.array([r[0] for r in first], dtype=np.float64)
    centers, moving = {k: start[:k] for k in ks}, list(dict.fromkeys(ks))
    slim = df.select(F.col(vector).cast("array<double>"))
    for _ in range(steps):
        if not moving:
            break
        now = [centers[k] for k in moving]

        def partial(b: pa.RecordBatch, now=now) -> np.ndarray:
            x, out = _matrix(b.column(0)), []
            for c in now:
                code, sums = _nearest(x, c), np.zeros_like(c)
                np.add.at(sums, code, x)
                out += [np.bincount(code, minlength=len(c)).astype(np.float64), sums.ravel()]
            return np.concatenate(out)

        total, at, still = _summed(slim, partial, sum(len(c) * (c.shape[1] + 1) for c in now)), 0, []
        for k, c in zip(moving, now):
            n = total[at : at + len(c)]
            sums = total[at + len(c) : at + c.size + len(c)].reshape(c.shape)
            at += c.size + len(c)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            if np.abs(new - c).max(initial=0) >= 1e-9:
                still.append(k)
            centers[k] = new
        moving = still
    return centers


def codebook_sweep(
    df: DataFrame,
    ks=(4, 8, 16, 32),
    label: str = "speaker",
    steps: int = 20,
    sample: int | None = None,
    id: str = "frame_id",
    vector: str = "feature",
) -> DataFrame:
    """(k, silhouette, ari, nmi, active, entropy_bits, verdict) of a codebook of each size: how well its codes part the vectors, how little they tell
    of the label. sample: rows of the silhouette."""
    out, centers, coded = None, codebooks(df, ks, vector, id, steps), df
    for k in centers:
        coded = encode(coded, centers[k], vector, f"__code{k}")
    coded = stored(coded, "codes")
    apart = stored(metrics.silhouettes(coded, [f"__code{k}" for k in centers], id, vector, sample=sample), "silhouettes")
    for k in centers:
        codes = coded.withColumn("code", F.col(f"__code{k}"))
        parts = F.broadcast(apart.select(F.col(f"__code{k}").alias("silhouette"))), F.broadcast(metrics.agreement(codes, "code", label)), F.broadcast(codebook_quality(codes, k))
        row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).select(F.lit(k).alias("k"), "silhouette", "ari", "nmi", "active", "entropy_bits")
        out = row if out is None else out.unionByName(row)
    good = (F.col("silhouette") > 0.1) & (F.col("ari") < 0.1) & (F.col("active") >= 0.75 * F.col("k"))
    return out.withColumn("verdict", F.when(good, "feasible").when((F.col("silhouette") > 0.05) & (F.col("ari") < 0.2), "partial").otherwise("not viable"))
