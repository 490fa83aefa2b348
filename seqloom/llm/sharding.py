"""Sharding in Hilbert-curve order.

Several metadata dimensions are quantised into equi-depth bins (thresholds from all rows), the bins' Hilbert index
orders the rows, and the ordered rows are cut into runs whose lengths differ by one at most. Rows near each other in
all dimensions share a shard, so the minimum and maximum of each column prune files for filters on any of them.

Dimensions may be numbers, strings, booleans, dates and timestamps. Only DataFrame operations run here. Rows are range-partitioned by (index, ties),
so a bin that holds a third of all
rows is split; each partition's number of rows, one number a partition, gives the others' offsets.

Defined results: a null value falls into the lowest bin of its dimension; ties in the index are ordered by the given
columns; rows equal in all of them are interchangeable and get a slot each; with fewer rows than shards the last ones
stay empty; an empty table gives an empty result; columns of the input named hilbert, shard or slot are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def order_code(column: str, kind: str) -> Column:
    """A number or string whose order is the column's."""
    c = F.col(f"`{column}`")
    if kind in NUMBERS or kind.startswith("decimal") or kind == "string":
        return c
    if kind == "boolean":
        return c.cast("int")
    if kind == "date":
        return F.unix_date(c)
    if kind == "timestamp":
        return F.unix_micros(c)
    raise ValueError(f"{column}: {kind} has no order to shard by")


def hilbert_index(axes: Column, dims: int, bits: int) -> Column:
    """The Hilbert index of an array of dims numbers below 2**bits, after J. Skilling's transform (2004)."""
    put = lambda xs, i, v: F.transform(xs, lambda x, j: F.when(j == i, v).otherwise(x))
    flips = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(dims)]
    steps = F.array(*(F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q, i in flips)) if flips else F.array().cast("array<struct<q:bigint,i:int>>")

    def undo(xs: Column, step: Column) -> Column:
        low, at = step["q"] - 1, xs[step["i"]]
        differ = xs[0].bitwiseXOR(at).bitwiseAND(low)
        inverted = put(xs, F.lit(0), xs[0].bitwiseXOR(low))
        swapped = F.transform(xs, lambda x, j: F.when((j == 0) | (j == step["i"]), x.bitwiseXOR(differ)).otherwise(x))
        return F.when(at.bitwiseAND(step["q"]) != 0, inverted).when(step["i"] == 0, xs).otherwise(swapped)

    zero, powers = F.lit(0).cast("bigint"), [1 << b for b in range(bits - 1, 0, -1)]
    powers = F.array(*(F.lit(q).cast("bigint") for q in powers)) if powers else F.array().cast("array<bigint>")
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))

    def interleaved(xs: Column) -> Column:
        return F.aggregate(levels, zero, lambda h, b: F.aggregate(xs, h, lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("bigint")))))

    def folded(g: Column) -> Column:
        return F.aggregate(powers, zero, lambda t, q: F.when(g[dims - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def last(g: Column) -> Column:
        return _let(folded(g), lambda t: F.transform(g, lambda x: x.bitwiseXOR(t)))

    def gray(xs: Column) -> Column:
        return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, 1, i + 1), zero, lambda a, y: a.bitwiseXOR(y)))

    return _let(F.aggregate(steps, axes, undo), lambda xs: _let(gray(xs), lambda g: _let(last(g), interleaved)))


def _let(value: Column, of) -> Column:
    """of(value), with value evaluated once however often `of` names it."""
    return F.transform(F.array(value), of)[0]


def string_edges(rows: DataFrame, column: Column, parts: int) -> list[str]:
    """The values at which a table sorted by a string column is cut into parts of equal length, at most parts - 1.

    Distinct values, counted before the shuffle, are range-partitioned, so neither a frequent value nor many values fill a
    task; sums within partitions and one number a partition give each value's place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select(column.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    placed = stored(counted.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "values")
    parts_n = placed.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a partition
    total, before = sum(r["n"] for r in parts_n), {}
    if not total:
        return []
    offset = 0
    for part, held in sorted(map(tuple, parts_n)):
        before[part], offset = offset, offset + held
    so_far = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.element_at(F.from_json(F.lit(json.dumps(before)), "map<string,bigint>"), F.col("part").cast("string"))
    ends = placed.withColumn("z", offset + F.sum("n").over(so_far)).withColumn("a", F.col("z") - F.col("n"))
    # a value is an edge if the place of a cut, ceil(i * total / parts) from 1, lies in it
    cut = lambda x: F.floor(x * F.lit(parts) / F.lit(total))
    return sorted(r["v"] for r in ends.filter((cut(F.col("z")) > cut(F.col("a"))) & (F.col("a") < F.lit(total * (parts - 1) / parts))).select("v").collect())


def bins(rows: DataFrame, dims: list[str], bits: int) -> Column:
    """An array of the equi-depth bins of the dimensions, by their whole values. The thresholds, 2**bits - 1 values a dimension at most, come to the driver."""
    kinds = dict(rows.dtypes)
    cuts = F.array(*(F.lit(i / (1 << bits)) for i in range(1, 1 << bits)))
    codes = {c: order_code(c, kinds[c]) for c in dims}
    numbers = [c for c in dims if kinds[c] != "string"]
    found = rows.agg(F.lit(0).alias("none"), *(F.percentile_approx(codes[c], cuts, F.lit(10_000)).alias(f"c{k}") for k, c in enumerate(numbers))).first()
    edges = {c: sorted(set(found[f"c{k}"] or [])) for k, c in enumerate(numbers)}
    edges |= {c: string_edges(rows, codes[c], 1 << bits) for c in dims if c not in edges}
    out = []
    for c in dims:
        above = F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda e: e < codes[c])) if edges[c] else F.lit(0)  # noqa: B023
        # spread over the whole range, so that a dimension with few values weighs as much as the others
        out.append(F.when(codes[c].isNull(), F.lit(0)).otherwise(F.floor(above * F.lit((1 << bits) - 1) / F.lit(max(1, len(edges[c]))))).cast("bigint"))
    return F.array(*out)


def hilbert_shards(rows: DataFrame, dims: list[str], ties: list[str], shards: int = 24, bits: int = 5, partitions: int | None = None) -> DataFrame:
    """rows with hilbert, shard (0 to shards - 1) and slot (gapless from 0 in each shard), stored in that order."""
    if len(dims) * bits > 62:
        raise ValueError("the index must fit in 62 bits")
    if clash := {"hilbert", "shard", "slot"} & set(rows.columns):
        raise ValueError(f"columns of the input would be lost: {sorted(clash)}")
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = rows.withColumn("__bins", bins(rows, dims, bits)).withColumn("hilbert", hilbert_index(F.col("__bins"), len(dims), bits)).drop("__bins")
    order = ["hilbert", *ties]
    placed = stored(coded.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "hilbert-order")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())  # one row a partition
    offset, before = 0, {}
    for part, count in counts:
        before[part], offset = offset, offset + count
    base, longer = divmod(offset, shards)
    offsets = F.element_at(F.from_json(F.lit(json.dumps(before)), "map<string,bigint>"), F.shiftright("__at", 33).cast("string"))
    rank = F.col("__rank")
    first = longer * (base + 1)
    shard = F.when(rank < first, F.floor(rank / (base + 1))).otherwise(longer + F.floor((rank - first) / max(base, 1)))
    start = F.when(F.col("shard") <= longer, F.col("shard") * (base + 1)).otherwise(first + (F.col("shard") - longer) * base)
    out = placed.withColumn("__rank", offsets + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", (rank - start).cast("bigint")).drop("__at", "__rank")


def document_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the dimensions and what identifies a row: its size in bytes plus 8 and its CRC-32."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder a shard, rows in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
