"""Quality classifier: random-indexing word vectors and a small network.

Each token has a sparse ternary index vector drawn from its hash. A word's vector is the sum of the index vectors of the
tokens next to it, over the whole corpus, plus its own. Words share 2**SLOT_BITS hashed slots, so the table of
vectors has one size whatever the vocabulary. Two marks are tokens of their own: a token that repeats the one before,
and a token in capitals. A document is the mean of its tokens' unit vectors, frequent ones weighted down. A network of
two layers, in NumPy, is fitted on at most `fit_rows` labelled documents (those of the smallest hashes), and a
temperature, fitted on every fifth of them, calibrates its probabilities.

Defined results: a null text is empty and an empty text gets the network's answer for the zero vector; rows with a
null label aren't learned from; a document with several labels is learned with the least of them; without labels of
both kinds all scores are the smoothed share of good labels; repeated rows get equal scores; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import mixed, summed, utf8

SLOT_BITS, DIMS, SPARSE = 15, 64, 4
SLOTS = 1 << SLOT_BITS
SAME, CAPITALS = SLOTS, SLOTS + 1
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")


def index_vectors() -> np.ndarray:
    """The places (of DIMS) and signs of each slot's index vector, as place * 2 + (sign < 0)."""
    drawn = mixed(np.arange((SLOTS + 2) * SPARSE, dtype=np.uint64) + np.uint64(1 << 40))
    return (drawn % np.uint64(2 * DIMS)).astype(np.int64).reshape(-1, SPARSE)


class Slots(dict):
    """token -> slot, with bit SLOT_BITS set for a token in capitals. Forgets all once it holds a million."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        lower = token.lower()
        slot = xxhash.xxh64_intdigest(lower) & (SLOTS - 1) | (SLOTS if len(token) > 1 and token.isupper() else 0)
        self[token] = slot
        return slot


def streams(batches: Iterator[pa.RecordBatch], column: int, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows first to last of a batch, in turn, the slots of all tokens, their marks (1 same as before, 2 capitals) and each row's first token."""
    slots = Slots()
    get = slots.__getitem__
    for b in batches:
        held, ends, first = [], [0], 0
        texts = b.column(column).to_pylist()
        for i, t in enumerate(texts):
            held.append(np.fromiter(map(get, TOKEN.findall(t)), np.int64))
            ends.append(ends[-1] + len(held[-1]))
            if ends[-1] >= most or i == len(texts) - 1:
                ids, starts = np.concatenate(held), np.array(ends)
                marks = (ids >> SLOT_BITS) << 1
                ids &= SLOTS - 1
                again = np.zeros(len(ids), dtype=bool)
                again[1:] = ids[1:] == ids[:-1]
                again[starts[:-1][starts[:-1] < len(ids)]] = False
                yield first, i + 1, ids, marks | again, starts
                held, ends, first = [], [0], i + 1


def corpus_vectors(rows: DataFrame, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the slots and their summed context vectors, over all rows."""
    size = SLOTS + 2

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        index = index_vectors()
        total = np.zeros(size * (DIMS + 1), np.int64)

        def add(at: np.ndarray, of: np.ndarray) -> None:
            for k in range(SPARSE):
                place = index[of, k]
                total[size:] += np.bincount(at * DIMS + (place >> 1), 1.0 - 2.0 * (place & 1), size * DIMS).astype(np.int64)

        for _, _, ids, marks, starts in streams(batches, column, 4_000_000):
            inner = np.ones(len(ids), dtype=bool)
            inner[starts[:-1][starts[:-1] < len(ids)]] = False
            right = np.flatnonzero(inner)
            same, capitals = np.flatnonzero(marks & 1), np.flatnonzero(marks & 2)
            marked = np.concatenate([np.full(len(same), SAME), np.full(len(capitals), CAPITALS)]).astype(np.int64)
            total[:size] += np.bincount(np.concatenate([ids, marked]), minlength=size)
            add(np.concatenate([ids[right - 1], ids[right], marked]), np.concatenate([ids[right], ids[right - 1], ids[np.concatenate([same, capitals])]]))
        return total

    total = summed(rows, count, size * (DIMS + 1))
    return total[:size], total[size:].reshape(size, DIMS)


def weighted_vectors(counts: np.ndarray, contexts: np.ndarray, smooth: float = 1e-3) -> np.ndarray:
    """Unit vectors of context and own index vector, times smooth / (smooth + share of the slot)."""
    own = np.zeros_like(contexts, dtype=np.float64)
    for k, place in enumerate(index_vectors().T):
        np.add.at(own, (np.arange(len(own)), place >> 1), 1.0 - 2.0 * (place & 1))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight = smooth / (smooth + counts / max(1, counts[:SLOTS].sum()))
    weight[SLOTS:] = 1.0
    return (unit(unit(contexts.astype(np.float64)) + unit(own)) * weight[:, None]).astype(np.float32)


def pooled(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each row's tokens and marks; the zero vector for rows without tokens."""
    out = np.zeros((len(starts) - 1, DIMS), np.float32)
    sizes = np.diff(starts)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(vectors[ids], starts[some], axis=0)
        for bit, slot in ((1, SAME), (2, CAPITALS)):
            share = np.add.reduceat(((marks & bit) > 0).astype(np.float32), starts[some])
            out[some] += share[:, None] * vectors[slot]
        out[some] /= sizes[some, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple | None
    prior: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.layers
        return np.tanh((x.astype(np.float64) - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40))), 9)  # a product's last digits depend on the batch


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the cross entropy of four fifths of the rows, then the temperature on the rest."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Network(np.zeros(DIMS), np.ones(DIMS), None, prior)
    net = Network(x.mean(0).astype(np.float64), x.std(0).astype(np.float64) + 1e-6, None, prior)
    rng = np.random.default_rng(seed)
    ws = [rng.normal(0, DIMS**-0.5, (DIMS, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(prior / (1 - prior)))]
    aside = np.arange(len(y)) % 5 == 4
    a, b = ((x[~aside] - net.mean) / net.scale, y[~aside].astype(np.float64))
    m, v, step = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    for _ in range(epochs):
        order = rng.permutation(len(b))
        for i in range(0, len(b), 256):
            xs, ys = a[order[i : i + 256]], b[order[i : i + 256]]
            h = np.tanh(xs @ ws[0] + ws[1])
            d = (1 / (1 + np.exp(-np.clip(h @ ws[2] + ws[3], -40, 40))) - ys) / len(ys)
            dh = d[:, None] * ws[2] * (1 - h * h)
            step += 1
            for k, g in enumerate((xs.T @ dh + decay * ws[0], dh.sum(0), h.T @ d + decay * ws[2], d.sum())):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                ws[k] = ws[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.layers = tuple(ws)
    if len(set(y[aside].tolist())) == 2:
        z, t = net.logits(x[aside]), y[aside]
        loss = lambda temperature: np.logaddexp(0, np.where(t == 1, -z, z) / temperature).mean()
        net.temperature = min(np.geomspace(0.25, 16, 97), key=loss)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, Network]:
    """The word vectors of the whole corpus and the network. labels: (doc_id, label) of the rows to learn from."""
    vectors = weighted_vectors(*corpus_vectors(docs.select(F.lit(0), utf8(text).alias("text"))))
    of = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.min(label) > 0).cast("int").alias("__y"))
    chosen = of.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)  # fit_rows rows of 16 bytes: small enough to broadcast
    learned = docs.select(F.col(doc_id).alias("__id"), utf8(text).alias("text")).join(F.broadcast(chosen), "__id").select("__id", "__y", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, *stream in streams(iter([b]), 2):
                x = pooled(*stream, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    rows = sorted((r[0], r[1], bytes(r[2])) for r in learned.mapInArrow(features, "id bigint, y int, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, DIMS)
    y = np.array([r[1] for r in rows], dtype=np.int64)
    shuffled = np.argsort(mixed(np.arange(len(y), dtype=np.uint64)))
    return vectors, fit(x[shuffled], y[shuffled])


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            for first, last, *stream in streams(iter([b]), 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(net.score(pooled(*stream, vectors)))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text")).mapInArrow(scores, "doc_id bigint, score double")
