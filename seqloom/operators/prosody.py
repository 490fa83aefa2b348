"""Durations, pitch, prosody features and gender rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators.sampling import draw


def normal(seed: int, *columns: str) -> Column:
    """A standard normal number by MD5 of identifiers (Box-Muller)."""
    u = lambda k: (draw(seed + k, *columns) + 0.5) / F.lit(float(1 << 32))
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))


def mixed_duration(predicted: Column, true: Column, weight: float, noise: Column | float = 0.0, least: int = 1, most: int = 50) -> Column:
    """weight * predicted + (1 - weight) * true, times 1 + noise, rounded half to even, within [least, most]."""
    raw = (F.lit(weight) * predicted + F.lit(1 - weight) * true) * (1 + (noise if isinstance(noise, Column) else F.lit(float(noise))))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(raw, 0).cast("int")))


def perturbed_bins(df: DataFrame, key: str, duration: str, width: int, spread: float, seed: int = 8) -> DataFrame:
    """df with duration times 1 + spread * a normal number, in frames, one at least; one number for each bin."""
    return df.withColumn("perturbed", F.greatest(F.lit(1), F.bround(F.col(duration) * (1 + F.lit(spread) * normal(seed, key, "bin")), 0).cast("int")))


def noisy_seconds(seconds: Column, noise: Column, step: float = 0.02, least: float = 0.02, most: float = 0.5) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(seconds * (1 + noise) / F.lit(step), 0) * F.lit(step)))


def normalized_f0(df: DataFrame, key: str, f0: str, center: float = 150.0, spread: float = 30.0, shift: float = 0.0, eps: float = 1e-8) -> DataFrame:
    """df with f0_out: voiced values (above 0) by their key's mean and population deviation onto center + shift and spread; unvoiced 0. Statistics are
    joined back, so no key is gathered."""
    facts = df.filter(F.col(f0) > 0).groupBy(key).agg(F.avg(f0).alias("__m"), F.stddev_pop(f0).alias("__s"))
    z = (F.col(f0) - F.col("__m")) / (F.col("__s") + F.lit(eps))
    return df.join(facts, key, "left").withColumn("f0_out", F.when(F.col(f0) > 0, z * spread + center + shift).otherwise(F.lit(0.0))).drop("__m", "__s")


def prosody(df: DataFrame, key: list[str], pos: str = "pos", vector: str = "feature", voiced: Column | None = None) -> DataFrame:
    """(key, mean, std, range, slope, contrast, voiced, silence) of the norms: population deviation, regression on place (0 for fewer than 4), second
    half less first, shares of voiced and other rows."""
    voiced = F.lit(True) if voiced is None else voiced
    rows = df.select(*key, F.col(pos).cast("double").alias("__x"), vec.norm(F.col(vector)).alias("__e"), voiced.alias("__v"))
    ends = rows.groupBy(*key).agg(F.avg("__x").alias("__mid"))
    rows = rows.join(ends, key)
    late, early = F.avg(F.when(F.col("__x") > F.col("__mid"), F.col("__e"))), F.avg(F.when(F.col("__x") < F.col("__mid"), F.col("__e")))
    share = F.avg(F.col("__v").cast("double"))
    slope = F.when(F.count("*") >= 4, F.regr_slope("__e", "__x")).otherwise(F.lit(0.0))
    return rows.groupBy(*key).agg(F.avg("__e").alias("mean"), F.stddev_pop("__e").alias("std"), (F.max("__e") - F.min("__e")).alias("range"), slope.alias("slope"), F.coalesce(late - early, F.lit(0.0)).alias("contrast"), share.alias("voiced"), (1 - share).alias("silence"))


def window_stats(df: DataFrame, key: list[str], dims: int, pos: str = "pos", vector: str = "feature") -> DataFrame:
    """(key, stats): mean, deviation, mean absolute difference and deviation of differences, one behind the other: 4 x dims. key must name windows,
    which are small."""
    before = F.lag(vector).over(Window.partitionBy(*key).orderBy(pos))
    rows = df.withColumn("__d", vec.minus(F.col(vector), before))
    v, d = F.col(vector), F.col("__d")
    parts = [[F.avg(v[i]) for i in range(dims)], [F.stddev_pop(v[i]) for i in range(dims)], [F.coalesce(F.avg(F.abs(d[i])), F.lit(0.0)) for i in range(dims)], [F.coalesce(F.stddev_pop(d[i]), F.lit(0.0)) for i in range(dims)]]
    return rows.groupBy(*key).agg(F.array(*(x for part in parts for x in part)).alias("stats"))


def segment_stats(df: DataFrame, key: list[str], dims: int, pos: str = "pos", vector: str = "feature", eps: float = 1e-8) -> DataFrame:
    """(key, n, stats): mean, population deviation + eps and mean difference ((last - first) / (n - 1), 0 for one row): 3 x dims."""
    v, n = F.col(vector), F.count("*")
    first, last = F.min_by(vector, pos), F.max_by(vector, pos)
    some = df.groupBy(*key).agg(n.alias("n"), vec.mean_vector(v, dims).alias("__m"), F.array(*(F.stddev_pop(v[i]) + F.lit(eps) for i in range(dims))).alias("__s"), first.alias("__f"), last.alias("__l"))
    zipped = F.arrays_zip(F.col("__f").alias("f"), F.col("__l").alias("l"), F.array_repeat(F.col("n"), dims).alias("n"))
    delta = F.transform(zipped, lambda z: F.when(z["n"] > 1, (z["l"] - z["f"]) / (z["n"] - 1)).otherwise(F.lit(0.0)))
    return some.select(*key, "n", F.concat("__m", "__s", delta).alias("stats"))


def target_gender(source: Column, mode: str) -> Column:
    """same, cross, or a fixed M or F; genders as m and f."""
    if mode == "same":
        return source
    if mode == "cross":
        return F.when(source == "m", "f").when(source == "f", "m")
    return F.lit(mode.lower())
