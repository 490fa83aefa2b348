"""Evaluation metrics: word errors, overlaps, clustering agreement, silhouette, energies, probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators import blocks
from seqloom.storage import new_path, stored

#: Rows that a silhouette's task holds, the sums by cluster that it holds for them, and the distances that it makes at once.
TASK_ROWS, TASK_SUMS, HELD_PAIRS = 16_384, 1 << 24, 1 << 20


def words(text: Column) -> Column:
    """Lower-cased words parted by white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")


#: Distinct words of a pair that have a code point of their own.
MOST_WORDS = 0x10FFFF - 0x900


#: Characters for the first words of a vocabulary, in a table.
TABLE = "".join(chr(0x100 + i) for i in range(8192))


def _coded(text: Column, vocabulary: Column) -> Column:
    """Words as one character each, by their place in the vocabulary: from a table, or, in a large vocabulary, by way of UTF-32, behind the control
    characters and around the surrogates."""
    at = lambda w: F.array_position(vocabulary, w)
    known = F.array_join(F.transform(text, lambda w: F.element_at(F.split(F.lit(TABLE), ""), at(w).cast("int"))), "")
    places = F.transform(F.transform(text, at), lambda p: p + F.lit(0xFF) + F.when(p + F.lit(0xFF) >= 0xD800, F.lit(0x800)).otherwise(F.lit(0)))
    large = F.decode(F.unhex(F.array_join(F.transform(places, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")
    return F.when(F.size(vocabulary) <= len(TABLE), known).otherwise(large)


def word_errors(df: DataFrame, reference: str, hypothesis: str, empty_reference: str = "one") -> DataFrame:
    """df with distance and wer. empty_reference: the rate of words against none: 'one', 'inf' or 'zero'; none against none is 0.

    Each distinct word of a pair becomes a character, so Spark's own edit distance of strings counts words.
    """
    empty = F.when(F.size("__h") == 0, F.lit(0.0)).otherwise(F.lit({"one": 1.0, "inf": float("inf"), "zero": 0.0}[empty_reference]))
    out = df.withColumns({"__r": words(F.col(reference)), "__h": words(F.col(hypothesis))}).withColumn("__v", F.array_distinct(F.concat("__r", "__h")))
    many = F.raise_error(F.lit("a pair of texts with more than a million distinct words"))
    distance = F.when(F.size("__v") > MOST_WORDS, many.cast("bigint")).otherwise(F.levenshtein(_coded(F.col("__r"), F.col("__v")), _coded(F.col("__h"), F.col("__v"))).cast("bigint"))
    out = out.withColumn("distance", distance)
    return out.withColumn("wer", F.when(F.size("__r") == 0, empty).otherwise(F.col("distance") / F.size("__r"))).drop("__r", "__h", "__v")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words; 1 for two empty texts."""
    x, y = words(a), words(b)
    return F.when(F.size(F.array_union(x, y)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def grade(wer: Column) -> Column:
    return F.when(wer < 0.10, "excellent").when(wer < 0.30, "good").when(wer < 0.50, "fair").otherwise("poor")


def averages(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(f"avg_{c}") for c in columns), F.count("*").alias("n"))


def stage_deltas(df: DataFrame, order: str, stage: str, wer: str) -> DataFrame:
    """df (a row per stage) with delta, its rate less that of the stage before, and worst, the stage of the largest."""
    rows = df.withColumn("delta", F.col(wer) - F.lag(wer, 1, 0.0).over(Window.orderBy(order)))
    return rows.withColumn("worst", F.max(F.struct("delta", stage)).over(Window.partitionBy())[stage])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, nmi) of two labellings, from their table of counts; NMI is normalised by the mean of the entropies."""
    cells = contingency(df, a, b)
    pairs = lambda n: n * (n - 1) / 2
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("m")) for c in (a, b))
    n = cells.agg(F.sum("n").cast("double").alias("n"))
    facts = n.crossJoin(cells.agg(F.sum(pairs(F.col("n"))).alias("both"))).crossJoin(rows.agg(F.sum(pairs(F.col("m"))).alias("ra"), F.sum(F.col("m") * F.log("m")).alias("la"))).crossJoin(cols.agg(F.sum(pairs(F.col("m"))).alias("rb"), F.sum(F.col("m") * F.log("m")).alias("lb"))).crossJoin(cells.agg(F.sum(F.col("n") * F.log("n")).alias("lab")))
    expected = F.col("ra") * F.col("rb") / pairs(F.col("n"))
    most = (F.col("ra") + F.col("rb")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected))
    ha, hb = F.log("n") - F.col("la") / F.col("n"), F.log("n") - F.col("lb") / F.col("n")
    mutual = ha + hb - (F.log("n") - F.col("lab") / F.col("n"))
    return facts.select(ari.alias("ari"), F.when(ha + hb <= 0, F.lit(1.0)).otherwise(mutual / ((ha + hb) / 2)).alias("nmi"))


def silhouette(df: DataFrame, cluster: str, id: str = "frame_id", vector: str = "feature", block_rows: int = 2048, sample: int | None = None) -> DataFrame:
    """(silhouette,): the mean Euclidean silhouette; rows alone in their cluster count 0, rows without a cluster or a vector are left out.

    sample: over so many rows drawn by id instead of all, as all pairs of rows are compared.
    """
    return silhouettes(df, [cluster], id, vector, block_rows, sample).select(F.col(f"`{cluster}`").alias("silhouette"))


def silhouettes(df: DataFrame, clusters: list[str], id: str = "frame_id", vector: str = "feature", block_rows: int = 2048, sample: int | None = None) -> DataFrame:
    """A row with the silhouette by each of the clusterings, whose columns have their names; distances are made once for all of them.

    Rows are written to the shared folder once. A task holds some rows and their sums by cluster and reads all rows from there, `block_rows` at a
    time, so no row is copied for another one: what is shuffled and written grows as the rows do, and only the work and what is read with their square.
    """
    if sample is not None:
        from seqloom.operators.sampling import least_by_draw

        df = least_by_draw(df, [], df.agg(F.lit(sample).cast("bigint").alias("__keep")), id)
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(clusters))).filter("v is not null")
    spark, counts = df.sparkSession, []
    for i in range(len(clusters)):  # clusters by number, from 0; -1 for none
        names = stored(rows.groupBy(f"k{i}").agg(F.count("*").alias("n")).filter(f"k{i} is not null").select(f"k{i}", (F.row_number().over(Window.orderBy(f"k{i}")) - 1).alias(f"c{i}")), "clusters")
        counts.append(names.count())
        rows = rows.join(names, f"k{i}", "left").withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(-1)))
    rows.select("v", *(f"c{i}" for i in range(len(clusters)))).write.parquet(path := new_path(spark, "silhouette"))
    saved = spark.read.parquet(path)
    files, width = sorted(saved.inputFiles()), sum(counts)
    n = saved.count()
    own = max(1, min(TASK_ROWS, TASK_SUMS // max(1, width), -(-n // (4 * spark.sparkContext.defaultParallelism))))  # rows that a task holds

    def parts(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        return blocks.matrix(t, "v"), [t.column(f"c{i}").to_numpy() for i in range(len(counts))]

    def scores(x: np.ndarray, codes: list[np.ndarray]) -> list[tuple[int, float, int]]:
        sums, sizes = [np.zeros((len(x), k)) for k in counts], [np.zeros(k, np.int64) for k in counts]
        for y, others in _read(files, block_rows, parts):
            for size, code in zip(sizes, others):
                size += np.bincount(code[code >= 0], minlength=len(size))
            step = max(1, HELD_PAIRS // len(y))
            by = [_by_cluster(code, len(size)) for size, code in zip(sizes, others)]
            for at in range(0, len(x), step):
                d = _distances(x[at : at + step], y)
                for total, add in zip(sums, by):
                    add(d, total[at : at + step])
        out = []
        for i, (total, size, code) in enumerate(zip(sums, sizes, codes)):
            found = code >= 0
            total, code, at = total[found], code[found], np.arange(found.sum())
            a = total[at, code] / np.maximum(size[code] - 1, 1)
            means = total / np.maximum(size, 1)
            means[at, code] = np.inf
            b = means.min(axis=1, initial=np.inf)
            top = np.maximum(a, b)
            value = np.divide(b - a, top, out=np.zeros(len(at)), where=(size[code] > 1) & (b < np.inf) & (top != 0))
            value[np.isnan(a) | np.isnan(means).any(axis=1)] = np.nan
            out.append((i, float(value.sum()), len(value)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def result() -> pa.RecordBatch:
            found = scores(*parts(pa.Table.from_batches(held)))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), (pa.int32(), pa.float64(), pa.int64()))], ["which", "total", "n"])

        for batch in batches:
            for at in range(0, len(batch), own):
                held.append(batch.slice(at, own))
                n += len(held[-1])
                if n >= own:
                    yield result()
                    held, n = [], 0
        if held:
            yield result()

    found = saved.repartition(max(1, -(-n // own))).mapInArrow(run, "which int, total double, n bigint")
    mean = lambda i: F.sum(F.when(F.col("which") == i, F.col("total"))) / F.sum(F.when((F.col("which") == i) & (F.col("n") > 0), F.col("n")))
    return found.agg(*(mean(i).alias(c) for i, c in enumerate(clusters)))


def _read(files: list[str], most: int, parts: Callable[[pa.Table], tuple]) -> Iterator[tuple]:
    """What parts makes of the rows of Parquet files, so many of them at a time. The folder may be any that pyarrow opens."""
    import pyarrow.parquet as pq

    from seqloom.sources.npy import opened

    for name in files:
        store, path = opened(unquote(name) if name.startswith("file:") else name)
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(most):
                if len(batch):
                    yield parts(pa.Table.from_batches([batch]))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y; 0 between equal vectors."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    d = np.hstack([x * -2, a[:, None], np.ones((len(x), 1))]) @ np.hstack([y, np.ones((len(y), 1)), b[:, None]]).T
    close = np.flatnonzero(d <= 1e-8 * (a[:, None] + b.max()))  # what is left of two large numbers is exact to few digits
    for at in np.array_split(close, -(-len(close) // 65_536) or 1):
        i, j = np.divmod(at, len(y))
        d.ravel()[at] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def _by_cluster(code: np.ndarray, clusters: int) -> Callable[[np.ndarray, np.ndarray], None]:
    """A function that adds to sums by row and cluster what a matrix has in the columns of that cluster."""
    if clusters <= 64:
        own = (code[:, None] == np.arange(clusters)).astype(float)

        def add(d: np.ndarray, total: np.ndarray) -> None:
            total += d @ own
    else:
        order = np.argsort(code, kind="stable")[(code < 0).sum() :]
        which, first = np.unique(code[order], return_index=True)

        def add(d: np.ndarray, total: np.ndarray) -> None:
            if len(which):
                total[:, which] += np.add.reduceat(d[:, order], first, axis=1)

    return add


def utterance_similarity(a: DataFrame, b: DataFrame, key: str, dims: int, vector: str = "feature") -> DataFrame:
    """(key, similarity): cosine of the mean vectors of both sides."""
    means = [d.groupBy(key).agg(vec.mean_vector(F.col(vector), dims).alias(n)) for d, n in ((a, "a"), (b, "b"))]
    return means[0].join(means[1], key).select(key, vec.cosine(F.col("a"), F.col("b")).alias("similarity"))


def energy_retention(df: DataFrame, before: str, after: str) -> DataFrame:
    """(retention, change, n_bad): kept energy, mean relative change, rows with a NaN or infinity."""
    square = lambda c: vec.dot(F.col(c), F.col(c))
    bad = F.exists(after, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg((F.sum(square(after)) / F.sum(square(before))).alias("retention"), F.avg(vec.l2(F.col(before), F.col(after)) / vec.norm(F.col(before))).alias("change"), F.count_if(bad).alias("n_bad"))


def separation(df: DataFrame, before: str, after: str) -> DataFrame:
    """(style_share, content_share, mean_dot): mean norms of what is left and of what was taken off, as shares of the mean norm, and the mean of |left
    . taken off|, near 0 for an orthogonal projection."""
    gone = vec.minus(F.col(before), F.col(after))
    rows = df.select(vec.norm(F.col(before)).alias("a"), vec.norm(F.col(after)).alias("b"), vec.norm(gone).alias("c"), F.abs(vec.dot(F.col(after), gone)).alias("d"))
    return rows.agg((F.avg("b") / F.avg("a")).alias("style_share"), (F.avg("c") / F.avg("a")).alias("content_share"), F.avg("d").alias("mean_dot"))


def spread_within(df: DataFrame, keys: list[str], dims: int, vector: str = "feature") -> DataFrame:
    """(keys, n, intra_variance): the mean over dimensions of the population variance of each group."""
    v = F.col(vector)
    parts = [F.var_pop(v[i]) for i in range(dims)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), vec.total(F.array(*parts)).alias("__t")).select(*keys, "n", (F.col("__t") / dims).alias("intra_variance"))


def gate(retention: Column, n_bad: Column) -> Column:
    """What the sanity check says: blocked, go, caution or reconsider."""
    return F.when(n_bad > 0, "blocked").when(retention < 0.5, "go").when(retention < 0.8, "caution").otherwise("reconsider")


def probe_accuracy(df: DataFrame, label: str, vector: str = "feature", id: str = "frame_id", train: float = 0.8) -> float:
    """Accuracy of a logistic regression on held-out rows: how much of the label the vectors tell."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from seqloom.operators.sampling import train_test

    rows = train_test(df.select(id, F.col(label).cast("string").alias("l"), array_to_vector(F.col(vector)).alias("x")), id, train)
    rows = StringIndexer(inputCol="l", outputCol="y", handleInvalid="keep").fit(rows).transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50, regParam=1e-3).fit(rows.filter("is_train"))
    tested = model.transform(rows.filter("not is_train"))
    return float(tested.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] or 0.0)


def four_way_probe(df: DataFrame, vectors: list[str], labels: list[str], id: str = "frame_id") -> dict[tuple[str, str], float]:
    """Probe accuracy of each label from each vector."""
    return {(v, label): probe_accuracy(df, label, v, id) for v in vectors for label in labels}


def loudness(samples: Column, rate: int = 16_000) -> Column:
    """(rms, seconds) of an array of samples."""
    return F.struct(F.sqrt(vec.total(F.transform(samples, lambda x: x * x)) / F.size(samples)).alias("rms"), (F.size(samples) / F.lit(rate)).alias("seconds"))
