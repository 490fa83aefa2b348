"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def normalized(a: Column, eps: float = 1e-8) -> Column:
    return scaled(a, 1 / (norm(a) + F.lit(eps)))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(by, F.size(a)).alias("s")), lambda z: z["x"] * z["s"])


def sq_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std(a: Column, sample: bool = False) -> Column:
    """Population or sample standard deviation of the elements."""
    squares = total(F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(mean(a), F.size(a)).alias("m")), lambda z: (z["x"] - z["m"]) * (z["x"] - z["m"])))
    return F.sqrt(squares / (F.size(a) - (1 if sample else 0)))


def adain(content: Column, style: Column, floor: float = 1e-5) -> Column:
    """content with the mean and the sample deviation of style; deviations are at least floor."""
    clamp = lambda x: F.greatest(std(x, sample=True), F.lit(floor))
    zipped = F.arrays_zip(content.alias("x"), *(F.array_repeat(v, F.size(content)).alias(n) for n, v in (("m", mean(content)), ("s", clamp(content)), ("m2", mean(style)), ("s2", clamp(style)))))
    return F.transform(zipped, lambda z: (z["x"] - z["m"]) / z["s"] * z["s2"] + z["m2"])


def mean_vector(column: Column, dims: int) -> Column:
    """An aggregate: the mean of each dimension. Rows are combined before the shuffle, one row a key and task."""
    return F.array(*(F.avg(column[i]) for i in range(dims)))


def sum_vector(column: Column, dims: int) -> Column:
    return F.array(*(F.sum(column[i]) for i in range(dims)))


def each(column: str, name: str = "value"):
    """posexplode of a vector as (dim, name), dimensions from 0."""
    return F.posexplode(column).alias("dim", name)
