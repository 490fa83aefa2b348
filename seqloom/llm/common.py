"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.storage import new_path, scratch, stored

__all__ = ["Bloom", "bloom_of", "freed", "list_array", "mixed", "new_path", "row_key", "spread_join", "scratch", "stored", "summed", "sums", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def spread_join(rows: DataFrame, few: DataFrame, key: str, salt, how: str = "left", most: int = 100_000, salts: int = 32) -> DataFrame:
    """rows joined with a table of a row for each key, so that a key of many rows is never one task's: by a broadcast while
    that table, stored first, has at most `most` rows, else by key and salt, a hash of a row's columns, with a copy of it for each salt."""
    few = stored(few, "few")
    if few.count() <= most:
        return rows.join(F.broadcast(few), key, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def row_key(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs and the column that names each of its rows: doc_id if it is a whole number that is never null and never repeats, else __row, a number that
    docs are stored with."""
    if dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint"):
        times = docs.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.count("*").alias("n"))
        if times.filter("id is null or n > 1").isEmpty():
            return docs, doc_id
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over a task's batches, at whose end the worker gives its free memory back to the system: it may stay idle for a while beside those
    of the next stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def list_array(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from its flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def sums(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, pieces: int = 64) -> DataFrame:
    """(piece, salt, cells) of the sum over all tasks of the integer array of fixed length that count makes of a task's batches.

    Tasks send the pieces that aren't zero, packed; pieces are summed on the executors, in two steps where there are
    many tasks.
    """
    import zstandard

    kind, salts, size = "piece int, salt int, cells binary", max(1, rows.rdd.getNumPartitions() // 128), -(-length // pieces)

    def packed(piece: int, salt: int, cells: np.ndarray) -> tuple:
        return piece, salt, zstandard.ZstdCompressor(1).compress(cells.astype(np.int64).tobytes())

    def table(found: list[tuple]) -> list[pa.Array]:
        return [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = count(batches)
        cells = [total[i * size : (i + 1) * size] for i in range(pieces)]
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays(table([packed(i, salt, c) for i, c in enumerate(cells) if c.any()]), ["piece", "salt", "cells"])

    def add(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        total: np.ndarray | int = 0
        for x in t.column("cells"):
            total = total + np.frombuffer(unpack(x.as_py()), np.int64)
        return pa.table(table([packed(t.column("piece")[0].as_py(), 0, total)]), names=["piece", "salt", "cells"])

    parts = rows.mapInArrow(send, kind)
    if salts > 1:
        parts = parts.groupBy("piece", "salt").applyInArrow(add, kind)
    return parts.groupBy("piece").applyInArrow(add, kind)


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, pieces: int = 64) -> np.ndarray:
    """The sum that `sums` makes, on the driver; its size doesn't depend on the data."""
    import zstandard

    out, size, unpack = np.zeros(length, np.int64), -(-length // pieces), zstandard.ZstdDecompressor().decompress
    for piece, _, cells in sums(rows, count, length, pieces).collect():
        out[piece * size : (piece + 1) * size] = np.frombuffer(unpack(cells), np.int64)
    return out


class Bloom:
    """A Bloom filter over 64-bit hashes. Its size is fixed when it is made and is at most 2**28 bits (32 MB)."""

    HASHES = 5

    def __init__(self, n_bits: int, bits: np.ndarray | None = None):
        self.n_bits = n_bits
        self.bits = np.zeros(n_bits >> 3, dtype=np.uint8) if bits is None else bits

    @staticmethod
    def bits_for(rows: int) -> int:
        return 1 << min(28, max(13, int(10 * max(rows, 1)).bit_length()))

    def _places(self, keys: np.ndarray):
        step = mixed(keys) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(self.HASHES):
                yield (keys + np.uint64(i) * step) & np.uint64(self.n_bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for p in self._places(keys):
            found &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom_of(keys: DataFrame, piece: int = 1 << 16) -> Bloom:
    """A filter over the longs of a column, sized by their number. Each task sends the pieces that it has set; their union, 32 MB at most, comes to
    the driver."""
    n_bits = Bloom.bits_for(keys.count())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Bloom(n_bits)
        for b in batches:
            f.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        found = [(i, x.tobytes()) for i in range(-(-len(f.bits) // piece)) if (x := f.bits[i * piece : (i + 1) * piece]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["i", "bits"])

    def union(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table([t.column("i").slice(0, 1), pa.array([bits.tobytes()], pa.binary())], names=["i", "bits"])

    out = Bloom(n_bits)
    for i, bits in keys.mapInArrow(pieces, "i int, bits binary").groupBy("i").applyInArrow(union, "i int, bits binary").collect():
        out.bits[i * piece : i * piece + len(bits)] = np.frombuffer(bits, np.uint8)
    return out
