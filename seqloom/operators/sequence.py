"""Operators over ordered sequences: runs, windows, smoothing, differences, resampling.

Sequences come as rows (key, order columns, ...). Each operator works on chunks of bounded size with copies of the
neighbouring rows that it needs, so a key that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators.sampling import draw
from seqloom.storage import CHUNK, chunked, positioned, stored


def _window(key: str) -> Window:
    return Window.partitionBy(key, "chunk").orderBy("pos")


def segments(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """(key, seg, start, end, label): runs of equal labels as [start, end), numbered from 0 in each key. A null label is a label."""
    rows = chunked(df.select(key, *order, label), key, order, before=1)
    lag = F.lag(F.struct(label)).over(_window(key))
    starts = rows.withColumn("new", lag.isNull() | ~F.col(label).eqNullSafe(lag[label])).filter("not halo and new").select(key, F.col("pos").alias("start"), label)
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    runs = chunked(starts, key, ["start"], after=1)
    out = runs.withColumn("end", F.lead("start").over(_window(key))).filter("not halo")
    out = out.join(sizes, out[key].eqNullSafe(sizes[key])).drop(sizes[key])
    return out.select(key, F.col("pos").alias("seg"), "start", F.coalesce("end", "n").alias("end"), label)


def durations(segs: DataFrame) -> DataFrame:
    return segs.withColumn("duration", F.col("end") - F.col("start"))


def voiced_segments(segs: DataFrame, label: str, silence: list, least: int = 3) -> DataFrame:
    return segs.filter(~F.col(label).isin(silence) & (F.col("end") - F.col("start") >= least))


def bigrams(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """(prev, next, count) of labels next to each other within a key; keys of one row have none."""
    rows = chunked(df.select(key, *order, label), key, order, after=1)
    pairs = rows.withColumn("next", F.lead(label).over(_window(key))).filter("not halo").filter(F.col("next").isNotNull() & F.col(label).isNotNull())
    return pairs.groupBy(F.col(label).alias("prev"), "next").agg(F.count("*").alias("count"))


def transition_matrix(counts: DataFrame, states: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(prev, next, count, p) over all pairs of states (state): (c + alpha) / (sum(c + alpha) + 1e-10) for each prev. The states are few by their nature."""
    grid = states.select(F.col("state").alias("prev")).crossJoin(states.select(F.col("state").alias("next")))
    full = grid.join(counts, ["prev", "next"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    row = F.sum(F.col("count") + F.lit(alpha)).over(Window.partitionBy("prev"))
    return full.withColumn("p", (F.col("count") + F.lit(alpha)) / (row + F.lit(1e-10)))


def marginal(counts: DataFrame, states: DataFrame) -> DataFrame:
    """(state, p): the share of each state as a destination, unsmoothed; all equal without pairs."""
    ends = counts.groupBy(F.col("next").alias("state")).agg(F.sum("count").alias("n"))
    total, k = ends.agg(F.sum("n")), states.agg(F.count("*").alias("k"))
    both = states.join(ends, "state", "left").crossJoin(F.broadcast(total.toDF("total"))).crossJoin(F.broadcast(k))
    return both.select("state", F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(1 / F.col("k")).alias("p"))


def sparsity(counts: DataFrame, n_states: int) -> DataFrame:
    return counts.agg((1 - F.count_if(F.col("count") > 0) / F.lit(float(n_states) ** 2)).alias("sparsity"))


def sliding_windows(df: DataFrame, key: str, order: list[str], aggs: list, width: int = 20, hop: int = 10) -> DataFrame:
    """(key, win, start, end, aggs): full windows of width rows, one every hop. Each row goes to the ceil(width / hop) windows that hold it, keyed by
    (key, win), so no key is gathered."""
    rows = positioned(df, key, order)
    first = F.ceil((F.col("pos") - width + 1) / hop)
    wins = F.sequence(F.greatest(F.lit(0).cast("bigint"), first), F.floor(F.col("pos") / hop))
    spread = rows.filter(F.greatest(F.lit(0), first) <= F.floor(F.col("pos") / hop)).withColumn("win", F.explode(wins))
    out = spread.groupBy(key, "win").agg(F.count("*").alias("__n"), *aggs).filter(F.col("__n") == width).drop("__n")
    return out.withColumns({"start": F.col("win") * hop, "end": F.col("win") * hop + width})


def moving_average(df: DataFrame, key: str, order: list[str], value: str, k: int = 3) -> DataFrame:
    """(key, pos, value, smooth): centred mean of k rows (k + 1 for even k), the first and last value standing in beyond the ends; keys of fewer than
    3 rows are left as they are."""
    k += 1 - k % 2
    p = k // 2
    rows = chunked(df.select(key, *order, value), key, order, before=p, after=p)
    ends = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))
    near = Window.partitionBy(key, "chunk").orderBy("pos").rowsBetween(-p, p)
    out = rows.withColumn("sum", F.sum(value).over(near)).filter("not halo").join(ends, key)
    short, over = F.greatest(p - F.col("pos"), F.lit(0)), F.greatest(F.col("pos") + p - (F.col("n") - 1), F.lit(0))
    smooth = (F.col("sum") + short * F.col("first") + over * F.col("last")) / k
    return out.select(key, "pos", value, F.when(F.col("n") < 3, F.col(value)).otherwise(smooth).alias("smooth"))


def scanned(x: np.ndarray, decay: float, block: int = 64) -> np.ndarray:
    """y with y[i] = x[i] + decay * y[i - 1], y[-1] = 0: blocks of rows by one triangular matrix, what they end with by the same scan over blocks."""
    n = len(x)
    if n <= 1:
        return x.astype(np.float64)
    size = min(block, n)
    place = np.arange(size)
    steps = place[:, None] - place[None, :]
    within = np.where(steps >= 0, np.power(decay, np.maximum(steps, 0)), 0.0)
    rows = np.concatenate([x, np.zeros(-n % size)]).reshape(-1, size) @ within.T
    if len(rows) > 1:
        ends = scanned(rows[:, -1], decay**size, block)
        rows[1:] += ends[:-1, None] * np.power(decay, place + 1)[None, :]
    return rows.ravel()[:n]


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, chunk: int = CHUNK) -> DataFrame:
    """(key, pos, value, ema): y = alpha x + (1 - alpha) y', the first value as it is. A chunk of a sequence is an affine map of the y before it: chunks are
    scanned by themselves, their maps composed (a number a chunk), and what comes in is added, by its weight at each row."""
    kind, decay = dict(df.dtypes)[key], 1 - alpha
    rows = positioned(df.select(key, *order, value), key, order)
    plain = rows.select(key, F.floor(F.col("pos") / chunk).alias("chunk"), "pos", F.col(value).cast("double").alias("v"))

    def local(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        x, first = t.column("v").to_numpy(), t.column("pos")[0].as_py() == 0
        steps = alpha * x
        if first:
            steps[0] = x[0]
        return t.append_column("y", pa.array(scanned(steps, decay)))

    schema = f"`{key}` {kind}, chunk bigint, pos bigint, v double, y double"
    found = stored(plain.groupBy(key, "chunk").applyInArrow(local, schema), "ema")
    ends = found.groupBy(key, "chunk").agg(F.max_by("y", "pos").alias("y"))

    def carried(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")  # all chunks of a key but the last have `chunk` rows; a number a chunk
        y = scanned(t.column("y").to_numpy(), decay**chunk)
        return pa.table([t.column(key), pa.array(t.column("chunk").to_numpy() + 1), pa.array(y)], names=["__key", "__chunk", "__in"])

    into = ends.groupBy(key).applyInArrow(carried, f"__key {kind}, __chunk bigint, __in double")
    out = found.join(into, found[key].eqNullSafe(into["__key"]) & (found["chunk"] == into["__chunk"]), "left")
    weight = F.pow(F.lit(float(decay)), F.col("pos") % chunk + 1)
    return out.select(key, "pos", F.col("v").alias(value), (F.col("y") + F.coalesce(F.col("__in") * weight, F.lit(0.0))).alias("ema"))


def lagged(df: DataFrame, key: str, order: list[str], columns: list[str], by: int = 1) -> DataFrame:
    """df with pos and <column>_lag<by>."""
    rows = chunked(df, key, order, before=by)
    out = rows.withColumns({f"{c}_lag{by}": F.lag(c, by).over(_window(key)) for c in columns})
    return out.filter("not halo").drop("chunk", "halo")


def continuity(df: DataFrame, key: str, order: list[str], vector: str = "feature", low: float = 0.5) -> DataFrame:
    """(key, mean_cosine, low_share) of vectors next to each other."""
    rows = lagged(df, key, order, [vector]).filter(F.col(f"{vector}_lag1").isNotNull()).withColumn("c", vec.cosine(F.col(vector), F.col(f"{vector}_lag1")))
    return rows.groupBy(key).agg(F.avg("c").alias("mean_cosine"), F.avg((F.col("c") < low).cast("double")).alias("low_share"))


def step_quantiles(df: DataFrame, key: str, order: list[str], vector: str = "feature") -> DataFrame:
    """(p90, p99, most) of the distance between vectors next to each other."""
    rows = lagged(df, key, order, [vector]).filter(F.col(f"{vector}_lag1").isNotNull()).withColumn("d", vec.l2(F.col(vector), F.col(f"{vector}_lag1")))
    from seqloom.operators.stats import interpolated

    rows = stored(rows.select("d"), "steps")
    p90, p99 = (interpolated(rows, [], "d", share).withColumnRenamed("edge", name) for share, name in ((0.9, "p90"), (0.99, "p99")))
    return p90.crossJoin(F.broadcast(p99)).crossJoin(F.broadcast(rows.agg(F.max("d").alias("most"))))


def time_bins(df: DataFrame, key: str, order: list[str], width: int = 10) -> DataFrame:
    return positioned(df, key, order).withColumn("bin", F.floor(F.col("pos") / width))


def dominant(df: DataFrame, key: str, label: str, silence: list) -> DataFrame:
    """(key, dominant): the most frequent label that isn't silence, the smallest of several. Labels are counted before they are compared."""
    counts = df.filter(~F.col(label).isin(silence)).groupBy(key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), label))[label].alias("dominant"))


def resample_linear(df: DataFrame, key: str, order: list[str], vector: str, length: str) -> DataFrame:
    """(key, i, vector): each key's vectors stretched to `length` (a column, equal within the key) by linear interpolation, ends kept."""
    rows = positioned(df.select(key, *order, vector, length), key, order).select(key, "pos", vector, length)
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(length).alias("m")).filter("m > 0")
    at = sizes.select(key, "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)).alias("i"))
    at = at.withColumn("x", F.when(F.col("m") > 1, F.col("i") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))).withColumn("lo", F.floor("x"))
    at = at.withColumns({"hi": F.least(F.col("lo") + 1, F.col("n") - 1), "w": F.col("x") - F.col("lo")})
    lo = rows.select(F.col(key), F.col("pos").alias("lo"), F.col(vector).alias("a"))
    hi = rows.select(F.col(key), F.col("pos").alias("hi"), F.col(vector).alias("b"))
    both = at.join(lo, [key, "lo"]).join(hi, [key, "hi"])
    mixed = F.transform(F.arrays_zip(F.col("a").alias("a"), F.col("b").alias("b"), F.array_repeat("w", F.size("a")).alias("w")), lambda z: z["a"] * (1 - z["w"]) + z["b"] * z["w"])
    return both.select(key, "i", mixed.alias(vector))


def resample_nearest(df: DataFrame, key: str, order: list[str], label: str, length: str) -> DataFrame:
    """(key, i, label): labels at round-half-even(linspace(0, n - 1, length))."""
    rows = positioned(df.select(key, *order, label, length), key, order).select(key, "pos", label, length)
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(length).alias("m")).filter("m > 0")
    at = sizes.select(key, "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)).alias("i"))
    x = F.when(F.col("m") > 1, F.col("i") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))
    at = at.withColumn("pos", F.least(F.greatest(F.bround(x, 0).cast("bigint"), F.lit(0)), F.col("n") - 1))
    return at.join(rows.select(key, "pos", label), [key, "pos"]).select(key, "i", label)


def resample_floor(df: DataFrame, key: str, order: list[str], label: str, length: str) -> DataFrame:
    """(key, i, label): labels at floor(linspace(0, n - 1, length)), one at least."""
    rows = positioned(df.select(key, *order, label, length), key, order).select(key, "pos", label, length)
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.max(F.bround(F.col(length).cast("double"), 0))).cast("bigint").alias("m"))
    at = sizes.select(key, "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("i"))
    at = at.withColumn("pos", F.when(F.col("m") > 1, F.floor(F.col("i") * (F.col("n") - 1) / (F.col("m") - 1))).otherwise(F.lit(0)).cast("bigint"))
    return at.join(rows.select(key, "pos", label), [key, "pos"]).select(key, "i", label)


def shuffled_in_bins(df: DataFrame, key: str, order: list[str], label: str, width: int = 5, share: float = 0.3, seed: int = 3) -> DataFrame:
    """(key, pos, label): in a share of the full bins of width rows, drawn by hash, labels change places; the last, partial bin stays."""
    rows = time_bins(df.select(key, *order, label), key, order, width)
    size = F.count("*").over(Window.partitionBy(key, "bin"))
    drawn = draw(seed, key, "bin") < int(share * 2**32)
    moves = rows.withColumn("moves", drawn & (size == width))
    place = F.when(F.col("moves"), F.row_number().over(Window.partitionBy(key, "bin").orderBy(draw(seed + 1, key, "pos"), "pos")) - 1 + F.col("bin") * width).otherwise(F.col("pos"))
    return moves.select(key, place.cast("bigint").alias("pos"), label)
