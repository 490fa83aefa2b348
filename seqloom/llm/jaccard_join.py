"""N-gram Jaccard join with a prefix tree.

A document's set holds its distinct n-word shingles as 64-bit hashes. One global order puts
shingles that a fixed-size count sketch finds frequent behind the others, each band by hash, so a set's prefix (size -
needed overlap + 1 shingles; two sets that link share one) holds its rare shingles. Shingles that two sets or more have
are found by counting all of them; a document links with nothing unless that share of its shingles is shared.

Sets that a chain of shared prefix shingles joins make a cluster. The sets of a cluster, or for large ones those around each
hub, in blocks of bounded size, are stored in a path-compressed tree in the global order. A probe traverses it, sharing
the overlap counted so far among all sets below a node, and leaves a subtree when what remains of both cannot reach the
threshold any more. Each block probes its hub first; only sets that the hub's component hasn't taken in probe again.
Where a hub has several blocks, its sets outside of its largest component are then compared with the other blocks, so
every link between two components is found. Equal sets are one node, named by 63 bits of the set's 128-bit digest, so rows
without an identifier and rows that share one are nodes of their own. All shingles of two sets are compared, by 48 bits
each (four of the band, 44 of the hash); two of 1,000 shingles have a false match with a probability below 1e-7.

Bounds: the sketch has 2**23 cells, the filter of shared shingles 2**28 bits at most; both only steer the work.

Defined results: a null text is empty; a document without words has an empty set and is linked with nothing; fewer
words than n make one shingle; links join rows by their texts, never by equal identifiers; a null doc_id is no component's
id unless all of the component's are null; repeated rows are returned each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Bloom, bloom_of, freed, list_array, mixed, row_key, scratch, stored, sums, utf8
from seqloom.llm.components import components

BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CELL_BITS = 23
PIECES = 128


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word of a buffer of bytes, slice by slice. A word's hash doesn't depend on its place."""
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not WHITE[text[end]]:
            step = np.flatnonzero(WHITE[text[end : end + SLICE]])
            end += int(step[0]) if len(step) else min(SLICE, len(text) - end)
        part = text[at:end]
        if len(_tables.get("up", ())) <= len(part):
            _tables["up"], _tables["down"] = (_powers(b, max(SLICE + 256, len(part) + 1)) for b in (BASE, INVERSE))
        inside = np.concatenate([[False], ~WHITE[part], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        a, z = turns[::2], turns[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _tables["up"][: len(part)])])
            hashes.append(mixed((sums[z] - sums[a]) * _tables["down"][a] + (z - a).astype(np.uint64)))
        starts.append(a + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text, A-Z lower-cased."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, starts = word_hashes(np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8))
    first = np.searchsorted(starts, offsets)
    weights = mixed(np.arange(1, n + 2, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
        for k in range(n):
            whole += hashes[k : k + len(whole)] * weights[k]
        whole = mixed(whole)
        out = []
        for a, z in zip(first[:-1], first[1:]):
            if z - a >= n:
                out.append(np.unique(whole[a : z - n + 1]))
            elif z > a:
                out.append(mixed(np.array([(hashes[a:z] * weights[: z - a]).sum(dtype=np.uint64) + weights[n] * np.uint64(z - a)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """So many of the first shingles of a set of n that any set it links with has one of them among its own."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Of each batch the identifiers and the sets, some MB of text at a time."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * SLICE)))
            yield b.column(0).slice(a, z - a), shingle_sets(b.column(1).slice(a, z - a).to_pylist(), n)
            a = z


class PrefixTree:
    """Sorted sets in a path-compressed tree. A node: its run of shingles, children, sets that end here, depth behind the run, and below it the least
    and greatest size of a set and the greatest length of what is stored of one."""

    __slots__ = ("run", "children", "ends", "depth", "least", "most", "longest")

    def __init__(self, run, depth):
        self.run, self.depth, self.children, self.ends = run, depth, [], []

    @classmethod
    def of(cls, sets: list[np.ndarray], sizes: list[int]) -> PrefixTree:
        """sizes: of the whole sets; shingles that no other set has needn't be stored."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        stack: list[tuple] = []

        def build(lo: int, hi: int, depth: int) -> PrefixTree:
            a, z = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(a), len(z))
            differ = np.flatnonzero(a[depth:m] != z[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            node = cls(a[depth:end], end)
            while lo < hi and len(sets[order[lo]]) == end:
                node.ends.append((order[lo], sizes[order[lo]]))
                lo += 1
            while lo < hi:
                lead, cut = sets[order[lo]][end], lo + 1
                while cut < hi and sets[order[cut]][end] == lead:
                    cut += 1
                stack.append((node, lo, cut, end))
                lo = cut
            return node

        made = [root := build(0, len(sets), 0)]
        while stack:
            parent, lo, hi, depth = stack.pop()
            parent.children.append(node := build(lo, hi, depth))
            made.append(node)
        for node in reversed(made):  # children come behind their parents
            own = [size for _, size in node.ends]
            node.least = min(own + [c.least for c in node.children])
            node.most = max(own + [c.most for c in node.children])
            node.longest = max([node.depth] * bool(own) + [c.longest for c in node.children])
        return root

    def search(self, probe: np.ndarray, size: int, percent: int) -> Iterator[int]:
        """The sets whose Jaccard similarity with the probe is at least percent / 100."""
        n, stack = len(probe), [(self, 0)]
        lowest, highest = -(-percent * size // 100), 100 * size // percent
        while stack:
            node, shared = stack.pop()
            if node.most < lowest or node.least > highest:
                continue
            needed = percent * (size + max(node.least, lowest))
            if (100 + percent) * (shared + min(n, node.longest - node.depth + len(node.run))) < needed:
                continue
            left = n
            if len(node.run):
                at = np.searchsorted(probe, node.run)
                found = at < n
                found[found] = probe[at[found]] == node.run[found]
                shared += int(found.sum())
                left = n - int(at[-1]) - int(found[-1])
            if (100 + percent) * (shared + min(left, node.longest - node.depth)) < needed:
                continue
            for i, other in node.ends:
                if (100 + percent) * shared >= percent * (size + other):
                    yield i
            stack.extend((c, shared) for c in node.children)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_links(sets: list[np.ndarray], sizes: list[int], hub: int, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets of a block into the components that all its links make."""
    tree, joined, links = PrefixTree.of(sets, sizes), Union(len(sets)), []
    for i in [hub, *(i for i in range(len(sets)) if i != hub)]:
        if i == hub or joined.find(i) != joined.find(hub):
            links += [(i, j) for j in tree.search(sets[i], sizes[i], percent) if joined.join(i, j)]
    return links


def packed_tokens(tokens: np.ndarray) -> bytes:
    """Sorted shingles as the bytes of their differences, plane by plane, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.diff(tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_tokens(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def sketch(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The band of each of 2**CELL_BITS cells of shingles (see bands), and the sum of all cells.

    Cells are summed and turned into bands on the executors, so a byte a cell comes to the driver.
    """
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, seen = np.zeros(cells, np.uint32), set()
        for _, sets in _batches(batches, n):
            fresh = {xxhash.xxh3_128_digest(s.tobytes()): s for s in sets if len(s)}
            new = [s for d, s in fresh.items() if d not in seen]  # copies that one task reads count once
            seen.update(fresh)
            if new:
                np.add.at(total, (np.concatenate(new) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
        return total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in b.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([bands(c, int(c.sum())).tobytes() for c in counts], pa.binary())], ["piece", "total", "bands"])

    out, total, size = np.zeros(cells, np.uint8), 0, cells // PIECES
    for piece, held, found in sums(rows, count, cells, PIECES).mapInArrow(cut, "piece int, total bigint, bands binary").collect():
        out[piece * size : (piece + 1) * size] = np.frombuffer(found, np.uint8)
        total += held
    return out, total


def bands(counts: np.ndarray, total: int) -> np.ndarray:
    """The band of each cell in the global order: 0 up to 64 and thrice the mean of its piece, then one for each doubling, 15 at most."""
    base = 64 + 3 * total / len(counts)
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / base)), 0, 15).astype(np.uint8)


def ordered(hashes: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as integers whose natural order is the global one: four bits of the band, then 44 of the hash; and that order."""
    level = band[(hashes & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    tokens = level << np.uint64(44) | hashes >> np.uint64(20)
    order = np.argsort(tokens)
    return tokens[order], order


class SharedFilter:
    """A Bloom filter for each of 2**ranges ranges of mixed shingles, over those that two sets or more have."""

    def __init__(self, ranges: int, bits: int):
        self.ranges, self.bits, self.filters = ranges, bits, np.zeros((1 << ranges, bits >> 3), np.uint8)

    @staticmethod
    def keys(tokens: np.ndarray, ranges: int) -> np.ndarray:
        """Of the mixed shingle, the bits of the range and 32 behind it."""
        return mixed(tokens ^ np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(32 - ranges)

    def has(self, tokens: np.ndarray) -> np.ndarray:
        keys = self.keys(tokens, self.ranges)
        place = (keys >> np.uint64(32)).astype(np.int64)
        found = np.ones(len(tokens), dtype=bool)
        for p in Bloom(self.bits, self.filters[0])._places(mixed(keys)):
            found &= (self.filters[place, (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _runs(once: np.ndarray, more: np.ndarray, shift: int) -> pa.RecordBatch:
    """Sorted keys, those met once and those met more often, as a row for each range: keys >> shift."""
    cut = [{int(r): k for r, k in zip((x >> np.uint64(shift))[at], np.split(x, at[1:]))} if len(x) else {} for x in (once, more) for at in [np.flatnonzero(np.diff(x >> np.uint64(shift), prepend=np.uint64(2**64 - 1)))]]
    ranges = sorted(cut[0].keys() | cut[1].keys())
    columns = [[packed_tokens(part[r]) if r in part else None for r in ranges] for part in cut]
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["range", "once", "more"])


def shared_filter(rows: DataFrame, n: int, total: int, range_tokens: int = 2_000_000, most_ranges: int = 12) -> SharedFilter:
    """Counts each shingle by the sets that have it, copies in a batch once, and keeps those of two or more.

    Tasks send sorted runs for 2**most_ranges ranges at most; where the data need finer ones, a second pass parts the
    ranges again, so no task holds more than about range_tokens shingles of distinct sets.
    """
    fine = max(4, (total // range_tokens).bit_length())
    coarse = min(fine, most_ranges)
    bits = 1 << min(28 - fine, max(13, (2 * total >> fine).bit_length()))
    kind = "range int, once binary, more binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, times = np.unique(SharedFilter.keys(np.concatenate(held), fine), return_counts=True)
            return _runs(keys[times == 1], keys[times > 1], 32 + fine - coarse)

        for _, sets in _batches(batches, n):
            fresh = {xxhash.xxh3_128_digest(s.tobytes()): s for s in sets if len(s)}
            held += fresh.values()
            size += sum(map(len, fresh.values()))
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merged(once: list, more: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [unpacked_tokens(x) for x in once if x is not None]
        keys, times = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
        twice = [unpacked_tokens(x) for x in more if x is not None]
        return keys[times == 1], np.unique(np.concatenate([keys[times > 1], *twice]))

    def part_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 256):
                yield _runs(*merged(b.column(1)[a : a + 256].to_pylist(), b.column(2)[a : a + 256].to_pylist()), 32)

    def find(t: pa.Table) -> pa.Table:
        _, shared = merged(t.column("once").to_pylist(), t.column("more").to_pylist())
        f = Bloom(bits)
        f.add(mixed(shared))
        return pa.table([t.column("range").slice(0, 1), pa.array([f.bits.tobytes()], pa.binary())], names=["range", "bits"])

    runs = rows.mapInArrow(freed(emit), kind)
    if fine > coarse:
        runs = runs.repartition("range").mapInArrow(freed(part_again), kind)
    out = SharedFilter(fine, bits)
    for r, found in stored(runs.groupBy("range").applyInArrow(find, "range int, bits binary"), "filters").toLocalIterator():
        out.filters[r] = np.frombuffer(found, np.uint8)
    return out


def set_rows(rows: DataFrame, n: int, percent: int, band, shared) -> DataFrame:
    """A row per document: doc_id, n_shingles, digest of the set, its node, and for sets that may link, once a task for equal sets, their shared
    prefix shingles and all shared shingles, packed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for ids, sets in _batches(batches, n):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            prefixes, wholes = [], []
            for s, d in zip(sets, digests):
                prefix, whole = np.zeros(0, np.uint64), None
                if d not in seen and len(s):
                    seen.add(d)
                    if (met := shared.value.has(s)).sum() * 100 >= percent * len(s):
                        tokens, order = ordered(s, band.value)
                        met, size = met[order], prefix_length(len(s), percent)
                        prefix = tokens[:size][met[:size]]
                        whole = packed_tokens(tokens[met]) if len(prefix) else None
                prefixes.append(prefix)
                wholes.append(whole)
            prefix_lists = list_array(np.concatenate(prefixes).view(np.int64), [len(y) for y in prefixes], pa.int64())
            nodes = [int.from_bytes(d[:8], "big") >> 1 if len(s) else None for s, d in zip(sets, digests)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), prefix_lists, pa.array(wholes, pa.binary())], ["doc_id", "n_shingles", "node", "prefix", "tokens"])

    return rows.mapInArrow(freed(make), "doc_id bigint, n_shingles bigint, node bigint, prefix array<bigint>, tokens binary")


def block_join(members: DataFrame, percent: int, across: bool) -> DataFrame:
    """Links (a, b) within each (hub, block) of rows (hub, block, probe, node, component, size, tokens).

    Not across: all links of the block, as a forest. Across: each probe's links with sets of other components.
    """

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        node, component, size, tokens = range(3, 7)
        if across:
            base = [r for r in rows if not r[2]]
            if not base:
                return []
            tree, out = PrefixTree.of([r[tokens] for r in base], [r[size] for r in base]), {}
            for r in rows:
                if r[2]:
                    for j in tree.search(r[tokens], r[size], percent):
                        if base[j][component] != r[component]:
                            out.setdefault((r[component], base[j][component]), (r[node], base[j][node]))
            return list(out.values())
        at = next((i for i, r in enumerate(rows) if r[node] == r[0]), 0)
        return [(rows[i][node], rows[j][node]) for i, j in block_links([r[tokens] for r in rows], [r[size] for r in rows], at, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for b in batches:
            for *row, data in zip(*(c.to_pylist() for c in b.columns)):
                if (row[0], row[1]) != key:
                    if len(held) > 1:
                        out += links(held)
                    held, key = [], (row[0], row[1])
                held.append((*row, unpacked_tokens(data)))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if len(held) > 1:
            out += links(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], ["a", "b"])

    dealt = members.select("hub", "block", "probe", "node", "component", "size", "tokens")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "hub", "block").sortWithinPartitions("hub", "block").mapInArrow(freed(run), "a bigint, b bigint")


def _met(rows: DataFrame, keys: DataFrame):
    """rows whose `row` is in a filter over the longs of keys, and the filter's broadcast, to be destroyed once the rows are used."""
    wanted = rows.sparkSession.sparkContext.broadcast(bloom_of(keys))

    @F.pandas_udf("boolean")
    def may_be(ids: pd.Series) -> pd.Series:
        return pd.Series(wanted.value.has(ids.to_numpy(dtype=np.int64).view(np.uint64)), dtype=bool)

    return rows.filter(may_be("row")), wanted


def _block_links(blocks: DataFrame, nodes: DataFrame, percent: int, across: bool, name: str) -> DataFrame:
    """The stored links of block_join for blocks, which get size and tokens of their nodes. Sets that are in no block aren't moved."""
    known, wanted = _met(nodes.select("row", "size", "tokens"), blocks.select("row").distinct())
    out = stored(block_join(blocks.join(known, "row"), percent, across), name)
    wanted.destroy()
    return out


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 75, block_rows: int = 600) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach). block_rows: sets in a block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    with scratch(spark):
        counts, total = sketch(rows, n)
        band = spark.sparkContext.broadcast(counts)
        shared = spark.sparkContext.broadcast(shared_filter(rows, n, total))
        sets = stored(set_rows(rows, n, percent, band, shared).withColumn("row", F.monotonically_increasing_id()), "sets")
        band.destroy()
        shared.destroy()
        del counts

        nodes = sets.filter("tokens is not null").select("row", "node", F.col("n_shingles").alias("size"), "prefix", "tokens")
        links = _links(nodes, percent, block_rows)
        # a component's id is the least doc_id of all rows of its sets
        same = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        joined = stored(same.join(links, "node", "left").filter("n > 1 or component is not null"), "named")
        tops = joined.filter("component is not null").groupBy("component").agg(F.min("least").alias("top"))
        joined = joined.join(tops, "component", "left").select("node", F.coalesce("top", "least").alias("component"))
        out = sets.select("doc_id", "n_shingles", "node").join(joined, "node", "left")
        return stored(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "classes", outlives=True)


def _links(nodes: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(node, component) of the nodes that link.

    Nodes that a chain of shared prefix shingles joins are one block if they are few enough, so each set is moved once.
    Larger clusters are dealt by hub, in blocks.
    """
    carriers = stored(nodes.groupBy("node").agg(F.min("row").alias("row")), "carriers")  # of a set that several tasks have met, one
    once, wanted = _met(nodes, carriers.select("row"))
    by_token = once.select("node", F.explode("prefix").alias("token"))
    hubs = by_token.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").drop("other")
    members = stored(by_token.join(hubs, "token").select("hub", "node").distinct(), "members")
    wanted.destroy()
    clusters = components(members.select(F.col("node").alias("a"), F.col("hub").alias("b")), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block_rows).select("component")
    small = clusters.join(large, "component", "left_anti").select(F.col("component").alias("hub"), F.lit(0).alias("block"), "node", F.lit(1).alias("blocks"))

    apart = members.join(clusters.join(large, "component", "left_semi").select("node"), "node", "left_semi")
    counts = stored(apart.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "hubs")
    dealt = apart.join(counts, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).filter("blocks = 1 or node <> hub")
    hub_rows = counts.filter("blocks > 1").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"), "blocks")
    in_blocks = stored(small.unionByName(dealt.select("hub", "block", "node", "blocks")).unionByName(hub_rows).join(carriers, "node"), "blocks")

    none = F.lit(None).cast("bigint")
    edges = _block_links(in_blocks.withColumns({"probe": F.lit(False), "component": none}), nodes, percent, False, "links")
    found = components(edges)
    several = in_blocks.filter("blocks > 1")
    if several.limit(1).count():
        known = several.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = stored(known.select("hub", "block", "node", "row", "component"), "known")
        main = known.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        base = known.join(main.select("hub", "main"), "hub")
        rest = base.filter("component <> main").select("hub", F.col("block").alias("own"), "node", "row", "component").join(counts, "hub")
        probes = rest.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own", "node", "row", "component").filter("block <> own")
        both = base.select("hub", "block", F.lit(False).alias("probe"), "node", "row", "component").unionByName(probes.select("hub", "block", F.lit(True).alias("probe"), "node", "row", "component"))
        both = stored(both, "met")  # it is read three times
        found = components(edges.unionByName(_block_links(both, nodes, percent, True, "more-links")), "components-again")
    return found


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs of which one of each component is left, with all their columns: that with the smallest doc_id, a null one last.

    Where identifiers are null or repeat, rows are numbered first, so each row is judged by itself; of rows that are
    equal in identifier and component, the first by number is left.
    """
    rows, key = row_key(docs, doc_id)
    classes = join(rows, text, key, **how)
    if key == doc_id:
        gone = classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    else:
        of = classes.join(rows.select(F.col(key).alias("doc_id"), F.col(f"`{doc_id}`").cast("bigint").alias("__id")), "doc_id")
        best = of.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "doc_id"))["doc_id"].alias("__best"))
        gone = of.join(best, "component_id").filter("doc_id <> __best").select(F.col("doc_id").alias("__gone"))
    return rows.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
