"""Exact deduplication with a log-structured merge index.

Each input task fills memtables (digest -> best identifier, number of rows). A full memtable is flushed as one
sorted run: a row per digest range with the sorted digests (the leading 64 bits of a SHA-256), their identifiers, their counts and a Bloom filter.
Compaction takes the runs of one digest range at a time. Digests that no other run's filter admits pass straight
through, the others are merged, and the best identifier (largest here; smallest on request) is kept with the number of rows. Digests
that more than one row has are hits: their rows take identifier and number from the index. Before, their texts are read again and compared byte
for byte; where one digest stands for several texts, those are counted by themselves.

The number of digest ranges follows the number of rows, and a memtable collapses copies, so a group that holds a
third of all rows has one entry per run.

Defined results: a null text is the empty text, which is a text as any other; a null identifier never wins against a
non-null one; rows that repeat an identifier and a text are each marked as the identifier's row; an empty table
gives an empty result; further columns of the input are ignored by `verdicts` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Bloom, bloom_of, freed, spread_join, stored, utf8

NO_ID = -(2**63)


def _fold(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, largest: bool):
    """Sorted distinct digests, each with its best identifier (NO_ID: null) and its summed count."""
    order = np.argsort(keys, kind="stable")
    keys, ids, counts = keys[order], ids[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if largest:
        best = np.maximum.reduceat(ids, at)
    else:
        best = np.minimum.reduceat(np.where(ids == NO_ID, np.iinfo(np.int64).max, ids), at)
        best = np.where(best == np.iinfo(np.int64).max, NO_ID, best)
    return keys[at], best, np.add.reduceat(counts, at)


def _segments(parts: list[tuple]) -> pa.RecordBatch:
    """Runs as rows, each with a filter over its digests: (range, name, digests, identifiers, counts)."""
    out = []
    for bucket, name, keys, ids, counts in parts:
        f = Bloom(Bloom.bits_for(len(keys)))
        f.add(keys)
        out.append((bucket, name, keys.tobytes(), ids.tobytes(), counts.tobytes(), f.bits.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.string(), *[pa.binary()] * 4))], ["bucket", "run", "keys", "ids", "counts", "filter"])


def _merged(t: pa.Table, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests of all runs of a table, sorted, with their best identifiers and counts. Digests that no other run's filter admits aren't compared."""
    parts = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), Bloom(8 * len(r["filter"]), np.frombuffer(r["filter"], np.uint8))) for r in t.to_pylist()]
    through, meet = [], []
    for k, (keys, ids, counts, _) in enumerate(parts):
        hit = np.zeros(len(keys), dtype=bool)
        for j, other in enumerate(parts):
            if j != k:
                hit |= other[3].has(keys)
        through.append((keys[~hit], ids[~hit], counts[~hit]))
        meet.append((keys[hit], ids[hit], counts[hit]))
    merged = [np.concatenate(x) for x in zip(*meet)]
    if len(merged[0]):
        through.append(_fold(*merged, largest))
    keys, ids, counts = (np.concatenate(x) for x in zip(*through))
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order], counts[order]


def _larger(level: int, largest: bool):
    """The runs of (range, part) as one run of a level."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_segments([(key[0].as_py(), f"L{level}-{key[1].as_py()}", *_merged(t, largest))])])

    return merge


class LsmIndex:
    """The index. digest_bits: leading bits of the SHA-256 that it stores; what collides, byte verification parts."""

    RUN = "bucket int, run string, keys binary, ids binary, counts binary, filter binary"

    def __init__(self, keep: str = "largest", digest_bits: int = 64, memtable_rows: int = 200_000, range_rows: int = 200_000, fan: int = 32):
        if keep not in ("largest", "smallest"):
            raise ValueError(keep)
        self.largest, self.bits, self.memtable_rows, self.range_rows, self.fan = keep == "largest", digest_bits, memtable_rows, range_rows, fan

    def key(self, shas: list[str]) -> np.ndarray:
        return np.array([int(x[:16], 16) >> (64 - self.bits) << (64 - self.bits) for x in shas], dtype=np.uint64)

    def flush(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """Sorted runs of (doc_id, sha). n_rows sizes the digest ranges."""
        index, ranges = self, min(65536, max(1, -(-n_rows // self.range_rows)))

        def run(task: int, made: int, mem: list) -> pa.RecordBatch:
            keys, ids, counts = _fold(*(np.concatenate(x) for x in zip(*mem)), index.largest)
            bucket = ((keys >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            return _segments([(int(bucket[a]), f"{task}-{made}", keys[a:z], ids[a:z], counts[a:z]) for a, z in zip(cuts, [*cuts[1:], len(keys)])])

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, made, mem, held = TaskContext.get().partitionId(), 0, [], 0
            for b in batches:
                if len(b):
                    ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                    mem.append(_fold(index.key(b.column(1).to_pylist()), ids, np.ones(len(b), dtype=np.int64), index.largest))
                    held += len(mem[-1][0])
                if held >= index.memtable_rows:
                    yield run(task, made, mem)
                    made, mem, held = made + 1, [], 0
            if mem:
                yield run(task, made, mem)

        return rows.select("doc_id", "sha").mapInArrow(memtables, self.RUN)

    def compact(self, runs: DataFrame) -> DataFrame:
        """(digest, keep_id, n) for each digest of all runs.

        A task merges `fan` runs of one digest range at most. While a range may have more, levels of larger runs are
        written, so neither a range's runs nor the comparisons between them pile up in one task.
        """
        largest, level = self.largest, 0

        most = runs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        while most > self.fan:
            groups, level = -(-most // self.fan), level + 1
            larger = _larger(level, largest)
            runs = stored(runs.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "run"), F.lit(groups))).groupBy("bucket", "part").applyInArrow(larger, self.RUN), f"level{level}")
            most = groups if groups < most else 0

        def last(t: pa.Table) -> pa.Table:
            keys, ids, counts = _merged(t, largest)
            return pa.table([pa.array(keys.view(np.int64)), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(counts)], names=["digest", "keep_id", "n"])

        return runs.groupBy("bucket").applyInArrow(last, "digest bigint, keep_id bigint, n bigint")

    def hits(self, compacted: DataFrame) -> DataFrame:
        """(digest, keep_id, n), stored: the digests that several rows have."""
        return stored(compacted.filter("n > 1"), "hits")

    def hashed(self, hits: Bloom | None = None):
        """A function from batches of (doc_id, text) to (doc_id, sha, digest), or, with a filter over digests, to those that it admits, with norm."""
        index = self

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t.lower() for t in b.column(1).to_pylist()]
                shas = [hashlib.sha256(t).hexdigest() for t in texts]
                keys = index.key(shas)
                columns = [b.column(0), pa.array(shas, pa.string()), pa.array(keys.view(np.int64))]
                if hits is not None:
                    at = pa.array(np.flatnonzero(hits.has(keys)), pa.int64())
                    columns = [c.take(at) for c in columns] + [pa.array([texts[i] for i in at.to_pylist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "digest", "norm"][: len(columns)])

        return rows

    def verified(self, texts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(digest, keep_id, n) of the hits whose rows are equal byte for byte, and (sha, keep_id, n) of groups within the digests of which that isn't so.

        texts: (doc_id, text). The rows of hits are read again; grouping by digest and bytes collapses copies before the shuffle. A digest with
        one text keeps what the index says of it; only the rows of others are counted anew."""
        best = F.max if self.largest else F.min
        admitted = self.hashed(bloom_of(hits.select("digest")))
        rows = texts.mapInArrow(freed(admitted), "doc_id bigint, sha string, digest bigint, norm binary")
        found = stored(rows.groupBy("digest", "sha", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n")).drop("norm"), "texts")
        collided = stored(found.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "collided")
        apart = found.join(collided, "digest", "left_semi").filter("n > 1").select("sha", "keep_id", "n")
        return hits.join(collided, "digest", "left_anti").select("digest", "keep_id", "n"), apart


def _answers(docs: DataFrame, index: LsmIndex, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, sha, digest) of each row, the index's hits, and what `verified` makes of them."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), utf8(f"`{text}`").alias("text"))
    rows = stored(texts.mapInArrow(freed(index.hashed()), "doc_id bigint, sha string, digest bigint"), "digests")
    runs = stored(index.flush(rows, rows.count()), "runs")
    hits = index.hits(index.compact(runs))
    return rows, hits, *index.verified(texts, hits)


def _judged(rows: DataFrame, whole: DataFrame, apart: DataFrame, salt) -> DataFrame:
    """rows (sha, digest, ...) with keep_id and n of their group, null for texts that occur once. A group of any size is spread."""
    out = spread_join(rows, whole, "digest", salt)
    few = apart.select("sha", F.col("keep_id").alias("__keep"), F.col("n").alias("__n"))
    out = spread_join(out, few, "sha", salt)
    return out.withColumns({"keep_id": F.when(F.col("__n").isNull(), F.col("keep_id")).otherwise(F.col("__keep")), "n": F.coalesce("__n", "n")}).drop("__keep", "__n")


def verdicts(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: str = "largest",
    digest_bits: int = 64,
    memtable_rows: int = 200_000,
    fan: int = 32,
    index: LsmIndex | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. keep_id and group_size are the index's."""
    index = index or LsmIndex(keep, digest_bits, memtable_rows, fan=fan)
    rows, _, whole, apart = _answers(docs, index, text, doc_id)
    out = _judged(rows, whole, apart, F.xxhash64("doc_id"))
    out = out.withColumns({"group_size": F.coalesce("n", F.lit(1).cast("bigint")), "keep_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))})
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", digest_bits: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an identifier and a text, one stays. Rows that no hit touches are
    passed on without a shuffle; of groups, only the rows that the index keeps are moved."""
    index = LsmIndex(keep, digest_bits)
    _, hits, whole, apart = _answers(docs, index, text, doc_id)
    bloom = bloom_of(hits.select("digest"))

    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            shas = [hashlib.sha256(t.lower()).hexdigest() for t in texts]
            keys = index.key(shas)
            yield pd.DataFrame({"sha": shas, "digest": keys.view(np.int64), "hit": bloom.has(keys)})

    @F.pandas_udf("sha string, digest bigint, hit boolean")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return freed(marks)(batches)

    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = hashed.asNondeterministic()  # else Spark hashes for the filter and once more behind it, in two workers a task
    marked = docs.select(own.alias("r"), once(utf8(f"`{text}`")).alias("h"))
    number = F.col(f"r.`{doc_id}`").cast("bigint")
    touched = stored(marked.filter("h.hit").select("r", "h.sha", "h.digest"), "touched")
    some = _judged(touched, whole, apart, F.xxhash64(number))
    alone = some.filter("n is null").select("r.*")
    kept = some.filter(F.col("n").isNotNull() & number.eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.first("r").alias("r"))
    return marked.filter("not h.hit").select("r.*").unionByName(alone).unionByName(kept.select("r.*"))
