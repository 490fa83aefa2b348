"""Cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece model (B), with corpus-wide counts of the ids that end together.

Both tokenizers cut the same bytes, a space and the text. Byte offsets at which a token of A and one of B end cut the tokens into groups;
the two tokens that end there are linked. `aligned` gives each document's tokens and groups. Links are counted over the whole corpus:

* a link is one 64-bit key, the id of B in the upper and that of A in the lower half, so that the keys of an id of B are neighbours;
* each task makes partial counts by np.unique, so that a pair that a third of all links have is a row a task;
* the partial counts are range-partitioned and sorted by key; runs of equal keys are summed as they stream by, and each partition
  writes a count shard, two files of sorted keys and their counts, into the folder that all executors share;
* tasks that look counts up map those files into memory and find their keys by np.searchsorted. No link is shuffled and no task holds
  the table. Where that folder is no mounted file system, shards are read whole.

What comes to the driver is a row a shard and the largest count of each id of B, which the vocabularies bound.

Defined results: a null or empty text has no tokens; neither has one whose tokens don't spell a space and the text (SentencePiece may
normalise). Such documents have zeros and an empty digest. Texts of any length are taken whole: long ones are encoded in parts, cut at single
spaces between ASCII letters or digits, across which neither tokenizer joins. Rows that repeat a document count as documents of their own, null
identifiers stay, an empty table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import list_array, new_path, stored

SPACE = "▁"
#: Characters from which on a text is encoded in parts, and about how many a part has.
LONG = 1 << 20
#: A single space at which neither tokenizer joins what is before and behind it.
CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Runs of white space that overflow the faster encoder's stack; the slower one takes such texts.
BLANKS = re.compile(r"\s{4096}")
#: The pattern that parts texts before byte pairs are merged, as the vocabulary was made with; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a batch that leaves a task, and distinct keys that a task gathers before it sends partial counts.
BATCH_TOKENS, HELD_KEYS = 1 << 20, 1 << 22


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """The byte-level BPE of a tokenizer file. Merges must be numbered as their results; then ids are ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, values, special = whole["model"], byte_values(), {x["id"] for x in whole["added_tokens"]}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(b <= a for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merges aren't in the order of ids")
        spelt = {i: bytes(values[c] for c in t) for t, i in model["vocab"].items() if all(c in values for c in t)}
        self.bytes = [b"" if i in special else spelt[i] for i in range(max(spelt) + 1)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
        self.path = path

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def __call__(self, text: str) -> list[int]:
        if BLANKS.search(text):
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)


class PieceTokens:
    """A SentencePiece model, which puts a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


@functools.lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> tuple[ByteTokens, PieceTokens]:
    """Loaded once a worker."""
    return ByteTokens(byte_path), PieceTokens(piece_path)


def _parts(text: str, whole: bool) -> list[str]:
    """The parts of a long text; joined by single spaces they are the text."""
    out, at = [], 0
    while not whole and len(text) - at > LONG and (m := CUT.search(text, at + LONG)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


NONE = np.zeros(0, dtype=np.int32)


def align(text: str | None, a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of A, ids of B, A's tokens by group, B's tokens by group) of a text."""
    if not text:
        return NONE, NONE, NONE, NONE
    parts, want = _parts(text, b.inner), (" " + text).encode()
    ids = []
    for tokens in (a, b):
        found = [tokens(p) for p in parts]
        if b"".join(tokens.bytes[i] for x in found for i in x) != want:
            return NONE, NONE, NONE, NONE
        ids.append(np.concatenate([np.array(x, dtype=np.int32) for x in found]))
    ends = [np.cumsum(t.sizes[x]) for t, x in zip((a, b), ids)]
    at = [np.zeros(len(want) + 1, dtype=bool) for _ in ends]
    for x, e in zip(at, ends):
        x[e] = True
    met = at[0] & at[1]
    sizes = [np.diff(np.flatnonzero(met[e]), prepend=-1).astype(np.int32) for e in ends]
    return ids[0], ids[1], sizes[0], sizes[1]


LISTS = ("a", "b", "a_sizes", "b_sizes")


def _aligned(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, a, b, a_sizes, b_sizes), of BATCH_TOKENS tokens and a document more at most, from batches of (doc_id, text)."""
    a, b = tokenizers(byte_path, piece_path)

    def batch(ids: list, found: list[tuple]) -> pa.RecordBatch:
        lists = [list_array(np.concatenate(x) if x else NONE, [len(y) for y in x], pa.int32()) for x in (zip(*found) if found else [()] * 4)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", *LISTS])

    for t in batches:
        ids, found, n = [], [], 0
        for i in range(len(t)):
            ids.append(t.column(0)[i].as_py())
            found.append(align(t.column(1)[i].as_py(), a, b))
            n += len(found[-1][0]) + len(found[-1][1])
            if n > BATCH_TOKENS:
                yield batch(ids, found)
                ids, found, n = [], [], 0
        yield batch(ids, found)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, a_sizes, b_sizes) of each row: the ids of both tokenizers, and how many of them each group has."""
    rows = lambda batches: _aligned(batches, byte_path, piece_path)
    return _texts(docs, doc_id, text).mapInArrow(rows, "doc_id bigint, " + ", ".join(f"{c} array<int>" for c in LISTS))


def _digits(n: int) -> np.ndarray:
    """The decimal digits of the numbers below n as bytes with zeros before them, and a last byte for what follows."""
    width = len(str(max(n - 1, 1)))
    out = np.zeros((n, width + 1), dtype=np.uint8)
    rest = np.arange(n)
    for k in range(width - 1, -1, -1):
        out[:, k] = np.where((rest > 0) | (k == width - 1), rest % 10 + ord("0"), 0)
        rest = rest // 10
    return out


def groups_text(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, digits: np.ndarray) -> bytes:
    """The groups as a1,a2|b1;a3|b2,b3: decimal ids of A and of B."""
    ids, sizes = np.empty(len(a) + len(b), dtype=np.int64), np.empty(2 * len(a_sizes), dtype=np.int64)
    sizes[0::2], sizes[1::2] = a_sizes, b_sizes
    of_a = np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)
    ids[of_a], ids[~of_a] = a, b
    out = digits[ids]
    out[:, -1] = ord(",")
    last = np.cumsum(sizes) - 1
    out[last[0::2], -1], out[last[1::2], -1] = ord("|"), ord(";")
    flat = out.ravel()
    return flat[flat != 0][:-1].tobytes()


LINKS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys array<bigint>, times array<int>"


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digits = _digits(1)
    for t in batches:
        lists = [t.column(i) for i in range(1, 5)]
        flat = [x.flatten().to_numpy() for x in lists]
        ends = [np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) for x in lists]
        most = int(max((x.max(initial=0) for x in flat[:2]), default=0))
        if most >= len(digits):
            digits = _digits(most + 1)
        shas, keys, times = [], [], []
        for i in range(len(t)):
            a, b, a_sizes, b_sizes = (x[e[i] : e[i + 1]] for x, e in zip(flat, ends))
            shas.append(hashlib.sha256(groups_text(a, b, a_sizes, b_sizes, digits)).hexdigest() if len(a) else "")
            linked = b[np.cumsum(b_sizes) - 1].astype(np.int64) << 32 | a[np.cumsum(a_sizes) - 1]
            found, n = np.unique(linked, return_counts=True)
            keys.append(found)
            times.append(n.astype(np.int32))
        n = [pa.array(np.diff(e), pa.int64()) for e in ends[:3]]
        packed = [list_array(np.concatenate(x) if x else np.zeros(0, np.int64), [len(y) for y in x], k) for x, k in ((keys, pa.int64()), (times, pa.int32()))]
        yield pa.RecordBatch.from_arrays([t.column(0), *n, n[2], pa.array(shas, pa.string()), *packed], [c.split()[0] for c in LINKS.split(", ")])


def links(rows: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of aligned documents: their numbers, and the distinct keys of their links with
    how often each occurs. As every token has a byte at least, a group ends with one link."""
    return rows.mapInArrow(_linked, LINKS)


def linked_texts(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`links` of `aligned` in one pass of one worker, so that tokens don't leave it."""
    return _texts(docs, doc_id, text).mapInArrow(lambda batches: _linked(_aligned(batches, byte_path, piece_path)), LINKS)


def _run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sum of its counts."""
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def partial_counts(found: DataFrame) -> DataFrame:
    """(key, n): the counts of each task, a row a distinct key while a task's keys fit; tasks with more send what they have and go on."""

    def merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        found, inverse = np.unique(keys, return_inverse=True)
        return found, np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy().astype(np.int64)))
            n += len(held[-1][0])
            if n > HELD_KEYS:
                held = [merged(held)]
                n = len(held[0][0])
                if n > HELD_KEYS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "n"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], ["key", "n"])

    return found.select("keys", "times").mapInArrow(rows, "key bigint, n bigint")


def _opened(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith(("file:", "/")) else fs.FileSystem.from_uri(folder)


def count_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Writes the count shards into a shared folder: (first, last, n, name, ids, best), a row a shard; best: the largest count of each id of B in it.

    A task that is repeated writes files of another name, and only those of its row are ever read.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        name = uuid.uuid4().hex
        rest, spans, best = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], {}
        n, out = 0, None

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal n, out
            if not len(keys):
                return
            if out is None:
                store.create_dir(path, recursive=True)
                out = [store.open_output_stream(f"{path}/{name}.{x}") for x in ("keys", "counts")]
            for f, x in zip(out, (keys, counts)):
                f.write(x.tobytes())
            n += len(keys)
            spans.extend((int(keys[0]), int(keys[-1])))
            ids, at = np.unique(keys >> 32, return_index=True)
            for i, m in zip(ids.tolist(), np.maximum.reduceat(counts, at).tolist()):
                best[i] = max(best.get(i, 0), m)

        for b in batches:
            keys, counts = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns))
            keys, counts = _run_sums(keys, counts)
            write(keys[:-1], counts[:-1])
            rest = keys[-1:], counts[-1:]
        write(*rest)
        if out is None:
            return
        for f in out:
            f.close()
        packed = [np.array(x, dtype=np.int64).tobytes() for x in (list(best), list(best.values()))]
        columns = [pa.array([x], k) for x, k in zip((spans[0], spans[-1], n, name, *packed), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["first", "last", "n", "name", "ids", "best"])

    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(shard, "first bigint, last bigint, n bigint, name string, ids binary, best binary")


class Shards:
    """The count shards, mapped into memory where the folder is a mounted one. rows: (first, last, n, name) of each, sorted."""

    def __init__(self, folder: str, rows: list[tuple]):
        self.folder, self.rows, self.open = folder, rows, {}
        self.firsts = np.array([r[0] for r in rows], dtype=np.int64)

    def _arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            store, path = _opened(self.folder)
            files = [f"{path}/{self.rows[k][3]}.{x}" for x in ("keys", "counts")]
            local = store.type_name == "local"
            self.open[k] = tuple(np.memmap(f, np.int64, "r") if local else np.frombuffer(store.open_input_file(f).read(), np.int64) for f in files)
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; of keys that no shard has, 0."""
        out, shard = np.zeros(len(keys), np.int64), np.searchsorted(self.firsts, keys, "right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            own = shard == k
            held, n = self._arrays(k)
            at = np.minimum(np.searchsorted(held, keys[own]), len(held) - 1)
            out[own] = np.where(held[at] == keys[own], n[at], 0)
        return out


def counted(found: DataFrame, manifest: list, folder: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): n_best: links whose count no other key of their id of B exceeds."""
    best: dict[int, int] = {}
    for r in manifest:
        for i, n in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["best"], np.int64).tolist()):
            best[i] = max(best.get(i, 0), n)
    top = np.zeros(max(best, default=0) + 1, np.int64)
    top[list(best)] = list(best.values())
    shards = sorted((r["first"], r["last"], r["n"], r["name"]) for r in manifest)
    shared = found.sparkSession.sparkContext.broadcast((shards, top))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = Shards(folder, shared.value[0]), shared.value[1]
        for t in batches:
            keys, times = (t.column(i).flatten().to_numpy() for i in (6, 7))
            sizes = t.column(6).value_lengths().to_numpy(zero_copy_only=False)
            distinct, inverse = np.unique(keys, return_inverse=True)
            n = own.counts(distinct)
            is_best = (n == top[distinct >> 32])[inverse] if len(keys) else np.zeros(0, bool)
            of, docs = np.repeat(np.arange(len(t)), sizes), len(t)
            sums = [np.zeros(docs, np.int64), np.zeros(docs, np.int64)]
            np.add.at(sums[0], of, np.where(is_best, times, 0))
            np.add.at(sums[1], of, times * n[inverse] if len(keys) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*t.columns[:5], *map(pa.array, sums), t.column(5)], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.mapInArrow(rows, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in names))


def with_counts(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`counted` of whole documents. Texts are encoded once; their links are stored."""
    for path in (byte_path, piece_path):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    found = stored(linked_texts(docs, byte_path, piece_path, doc_id, text), "links")
    folder = new_path(docs.sparkSession, "counts")
    manifest = stored(count_shards(stored(partial_counts(found), "partial-counts"), folder), "shards").collect()
    return counted(found, manifest, folder)
