"""Linear algebra from sufficient statistics: sums are made on the executors, only matrices of the vectors' dimensions come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import vec


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(df: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over tasks of an array of fixed size; one row of it a task, summed by position before it comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += partial(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(-(-size // 4096)), pa.int32()), pa.array([total[i : i + 4096].tobytes() for i in range(0, size, 4096)], pa.binary())], ["i", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v, np.float64) for v in t.column("x").to_pylist())
        return pa.table([t.column("i").slice(0, 1), pa.array([x.tobytes()], pa.binary())], names=["i", "x"])

    out = np.zeros(size)
    for i, x in df.mapInArrow(run, "i int, x binary").groupBy("i").applyInArrow(add, "i int, x binary").collect():
        out[i * 4096 : i * 4096 + len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def covariance(df: DataFrame, dims: int, vector: str = "feature") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance)."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    total = _summed(df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")), partial, 1 + dims + dims * dims)
    n = int(total[0])
    mean = total[1 : dims + 1] / max(n, 1)
    return n, mean, total[dims + 1 :].reshape(dims, dims) / max(n, 1) - np.outer(mean, mean)


def pca(df: DataFrame, dims: int, components: int, vector: str = "feature", limit: int | None = None, unit: bool = False) -> dict[str, np.ndarray]:
    """Centered PCA: mean, components (rows, the largest element of each positive), variances and their shares. At most min(components, dims, n - 1,
    limit). unit: of the vectors scaled to unit length, as `transformed` then scales them too."""
    if unit:
        df = df.withColumn(vector, vec.normalized(F.col(vector)))
    n, mean, cov = covariance(df, dims, vector)
    k = max(0, min(components, dims, n - 1, limit if limit is not None else dims))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(k), np.abs(rows).argmax(1)]) if k else np.ones(0)
    total = max(float(np.maximum(values, 0).sum()), 1e-300)
    return {"mean": mean, "components": rows * signs[:, None], "variance": np.maximum(values[order], 0) * n / max(n - 1, 1), "ratio": np.maximum(values[order], 0) / total, "unit": unit}


def transformed(df: DataFrame, model: dict[str, np.ndarray], vector: str = "feature", out: str = "projected", whiten: bool = False) -> DataFrame:
    """df with the centered vectors in the components' coordinates, by unit variance if whitened. One matrix product a batch."""
    mean, w = model["mean"], model["components"].T
    if whiten:
        w = w / np.sqrt(np.maximum(model["variance"], 1e-12))
    if not model.get("unit"):
        return applied(df, w, vector, out, shift=mean)
    return applied(df.withColumn("__unit", vec.normalized(F.col(vector))), w, "__unit", out, shift=mean).drop("__unit")


def with_energy(df: DataFrame, model: dict[str, np.ndarray], energy: str, weight: float = 1.0, vector: str = "feature", out: str = "style") -> DataFrame:
    """df with the whitened components and, behind them, the energy vector times weight, together scaled to unit length."""
    rows = transformed(df, model, vector, "__z", whiten=True)
    joined = F.concat("__z", F.transform(F.col(energy).cast("array<double>"), lambda x: x * F.lit(weight)))
    return rows.withColumn(out, vec.normalized(joined)).drop("__z")


def applied(df: DataFrame, w: np.ndarray, vector: str = "feature", out: str = "projected", shift: np.ndarray | None = None) -> DataFrame:
    """df with out = (vector - shift) @ w."""
    shared = df.sparkSession.sparkContext.broadcast((w, shift))

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        w, shift = shared.value
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy()).astype(np.float64)
        return pd.Series(list((rows if shift is None else rows - shift) @ w))

    return df.withColumn(out, product(F.col(vector).cast("array<double>")))


def subspace(df: DataFrame, group: str, dims: int, components: int, vector: str = "feature", least: int = 1) -> dict[str, np.ndarray]:
    """The directions in which the groups' means differ: orthonormal rows and the shares of variance they explain. Groups may be many, as speakers
    are: their means stay on the executors (`sketches.leading`), the directions come to the driver."""
    from seqloom.operators.sketches import leading
    from seqloom.operators.stats import centroids

    found = leading(centroids(df, [group], dims, vector, least), components, "centroid")
    return {"basis": found["components"].reshape(-1, dims), "ratio": found["ratio"]}


def content_subspace(df: DataFrame, phones: int, dims: int, share: float = 0.95, phone: str = "phone") -> dict[str, np.ndarray]:
    """As subspace over all `phones` phones, absent ones as zero vectors, with as many directions as reach the share, phones - 1 at most."""
    from seqloom.operators.stats import centroids

    m = np.zeros((phones, dims))
    for r in centroids(df, [phone], dims).collect():
        if 0 <= r[phone] < phones:
            m[r[phone]] = r["centroid"]
    _, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    ratio = s**2 / max(float((s**2).sum()), 1e-300)
    k = min(int(np.searchsorted(np.cumsum(ratio), share)) + 1, phones - 1)
    return {"basis": vt[:k], "ratio": ratio[:k]}


def balanced_content_subspace(
    df: DataFrame,
    dims: int,
    per_class: int = 2000,
    silence=(0,),
    use_lda: bool = False,
    id: str = "frame_id",
    seed: int = 42,
    phone: str = "phone",
    vector: str = "feature",
) -> dict[str, np.ndarray]:
    """Of at most per_class rows of each phone, silence left out: the active phones - 1 directions in which their means differ, or those of LDA. With
    silence alone, or one phone, none."""
    from seqloom.operators.sampling import drawn, top_of_group, without_silence

    some = top_of_group(without_silence(df, phone, list(silence)), phone, [drawn(seed, id), F.col(id)], per_class)
    n = some.select(phone).distinct().count()
    if n < 2:
        return {"basis": np.zeros((0, dims)), "ratio": np.zeros(0)}
    if use_lda:
        return {"basis": lda(some, dims, phone, n - 1, vector), "ratio": np.zeros(0)}
    return subspace(some, phone, dims, n - 1, vector)


def projected_out(df: DataFrame, basis: np.ndarray, vector: str = "feature", out: str = "cleaned") -> DataFrame:
    """df with h (I - U' U): the part of each vector outside of the basis' span, for orthonormal rows."""
    return applied(df, np.eye(basis.shape[1]) - basis.T @ basis, vector, out)


def component(df: DataFrame, cleaned: str = "cleaned", vector: str = "feature", out: str = "component") -> DataFrame:
    return df.withColumn(out, vec.minus(F.col(vector), F.col(cleaned)))


def scatter(df: DataFrame, dims: int, label: str, vector: str = "feature") -> tuple[np.ndarray, np.ndarray]:
    """(between, within) scatter matrices. Labels are few: their means come to the driver."""
    from seqloom.operators.stats import centroids

    n, mean, cov = covariance(df, dims, vector)
    between = np.zeros((dims, dims))
    for r in centroids(df, [label], dims, vector).collect():
        d = np.array(r["centroid"]) - mean
        between += r["n"] * np.outer(d, d)
    return between, n * cov - between


def lda(df: DataFrame, dims: int, label: str, components: int, vector: str = "feature", ridge: float = 1e-6) -> np.ndarray:
    """Directions of the largest eigenvalues of inv(within + ridge) between, as rows of unit length (not orthogonal to each other). Where that has no
    inverse or no eigenvalues, the directions of the labels' means."""
    between, within = scatter(df, dims, label, vector)
    try:
        values, vectors = np.linalg.eig(np.linalg.inv(within + ridge * np.eye(dims)) @ between)
    except np.linalg.LinAlgError:
        return subspace(df, label, dims, components, vector)["basis"]
    order = np.argsort(-values.real)[:components]
    return vectors[:, order].real.T


def ridge_statistics(frames: DataFrame, speakers: DataFrame, utt: str = "utt", vector: str = "feature", embedding: str = "d", dims: int = 64, p: int = 8) -> DataFrame:
    """(i, j, g) and (i, j, h) in long form, part G or H: G = sum of n d d', H = sum of d (sum of s)', d with a 1 behind. An utterance's frames enter
    as their count and sum, so frames are read once and never joined."""
    sums = frames.groupBy(utt).agg(F.count("*").alias("n"), vec.sum_vector(F.col(vector), dims).alias("s"))
    rows = sums.join(speakers.select(utt, F.concat(F.col(embedding).cast("array<double>"), F.array(F.lit(1.0))).alias("d")), utt)
    i = rows.select("n", "s", "d", F.posexplode("d").alias("i", "di"))
    g = i.select("i", "di", "n", F.posexplode("d").alias("j", "dj")).groupBy("i", "j").agg(F.sum(F.col("n") * F.col("di") * F.col("dj")).alias("value"))
    h = i.select("i", "di", F.posexplode("s").alias("j", "sj")).groupBy("i", "j").agg(F.sum(F.col("di") * F.col("sj")).alias("value"))
    return g.select(F.lit("G").alias("part"), "i", "j", "value").unionByName(h.select(F.lit("H").alias("part"), "i", "j", "value"))


def ridge(statistics: DataFrame, p: int, dims: int, penalty: float | None = None) -> dict[str, np.ndarray | float]:
    """The map d -> s: A (p, dims), b (dims), from G and H; least squares where G isn't positive definite. penalty: max(2e-4, 2e-3 p / 128)."""
    penalty = max(2e-4, 2e-3 * p / 128) if penalty is None else penalty
    g, h = np.zeros((p + 1, p + 1)), np.zeros((p + 1, dims))
    for r in statistics.collect():  # (p + 1) x (p + 1 + dims) numbers
        (g if r["part"] == "G" else h)[r["i"], r["j"]] = r["value"]
    reg = g + penalty * np.eye(p + 1)
    try:
        low = np.linalg.cholesky(reg)
        x = np.linalg.solve(low.T, np.linalg.solve(low, h))
    except np.linalg.LinAlgError:
        x = np.linalg.lstsq(reg, h, rcond=None)[0]
    return {"A": x[:p], "b": x[p], "condition": float(np.linalg.cond(reg)), "residual": float(np.linalg.norm(g @ x - h))}


def eta(frames: DataFrame, speakers: DataFrame, model: dict, utt: str = "utt", vector: str = "feature", embedding: str = "d") -> DataFrame:
    """frames with eta = s - (d A + b); the speaker's part is computed once an utterance."""
    parts = applied(speakers, model["A"], embedding, "__part").select(utt, "__part")
    shift = F.array(*(F.lit(float(x)) for x in model["b"]))
    return frames.join(parts, utt).withColumn("eta", F.zip_with(vec.minus(F.col(vector), F.col("__part")), shift, lambda x, y: x - y)).drop("__part")
