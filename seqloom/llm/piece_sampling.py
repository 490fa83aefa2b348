"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's lattice holds every segmentation into pieces of the model. A piece has the probability (rank + 2.7)**-1, scaled
to sum to 1 over the vocabulary, because the model is a merge model whose scores are ranks. No piece crosses the start
of a run of spaces or a character that only bytes spell, so the lattice is a chain of small ones, each of which is built
once a task and kept; backward sums over it give every arc its exact conditional probability.

The search is A-star with the backward sums as its bound, so a node's priority is the Gumbel-perturbed log mass of all
segmentations below it, which the best of them attains. The first segmentation follows the most perturbed arc from
the root. Along a segmentation, the arcs not taken at each step are one node on the agenda, whose perturbed mass is a
Gumbel variable truncated at the value of the segmentation they were left from. The agenda's best node is split into
the arc drawn from it and what remains, and followed to the end: the k best perturbed segmentations, all distinct.
A segmentation's inclusion score is 1 - exp(-exp(log p - kappa)), kappa the (k+1)-th perturbed value (1 without one).

Random numbers are hashes of (seed, row key, segmentation, place), so results depend on neither batches nor tasks.

Defined results: a null text is empty; an empty text has one segmentation without pieces, of probability 1; a text with
fewer than k segmentations gives all of them; a null key is a key of its own; rows that repeat a key and a text get
equal segmentations; U+2581 becomes a space, as in the model's own normalisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import freed, list_array, mixed, utf8

SPACE = "▁"
NONE = -(2**31)
KNOWN_NODES = 600_000
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _uniform(keys: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys and places."""
    with np.errstate(over="ignore"):
        h = mixed(keys + np.asarray(place).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The vocabulary of a model: hashes of its pieces and of their beginnings, log probabilities, bytes."""

    def __init__(self, model: str):
        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.vocab_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ranks = np.full(n, float(n))
        ranks[sorted(usual, key=lambda i: (-m.get_score(i), i))] = np.arange(len(usual))
        weights = 1 / (ranks + 2.7)
        self.logp = np.log(weights / weights[usual].sum())
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        text = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.text, self.text_sizes = np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text])
        self.text_starts = np.concatenate([[0], np.cumsum(self.text_sizes)[:-1]])
        known: dict[int, int] = {}
        for i in usual:
            h = 0
            for k, c in enumerate(p := pieces[i]):
                h = ((h + ord(c) + 1) * int(FACTOR)) & 0xFFFFFFFFFFFFFFFF
                if k == len(p) - 1:
                    known[h] = i
                else:
                    known.setdefault(h, -1)
        self.hashes = np.append(np.array(sorted(known), dtype=np.uint64), np.uint64(2**64 - 1))
        self.ids = np.array([*(known[int(h)] for h in self.hashes[:-1]), NONE], dtype=np.int32)
        self.slots = np.searchsorted(self.hashes[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.steps = int(np.bincount((self.hashes[:-1] >> np.uint64(44)).astype(np.int64)).max())
        self.longest = max((len(pieces[i]) for i in usual), default=1)
        self.singles = {p for i in usual if len(p := pieces[i]) == 1}
        self.alone = "".join(c for c in "\n\t\r" if c not in self.singles)
        self.chunk = re.compile(f" *[^ {self.alone}]+| +|[{self.alone}]" if self.alone else " *[^ ]+| +")

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for the beginning of pieces, NONE for neither. Hashes that share their leading bits lie next to each other."""
        at, out, todo = self.slots[h >> np.uint64(44)], np.full(len(h), NONE, np.int32), None
        for _ in range(self.steps):
            if todo is None:
                hit = self.hashes[at] == h
                out[hit] = self.ids[at[hit]]
                todo = np.flatnonzero(self.hashes[at] < h)
            else:
                at[todo] += 1
                hit = todo[self.hashes[at[todo]] == h[todo]]
                out[hit] = self.ids[at[hit]]
                todo = todo[self.hashes[at[todo]] < h[todo]]
            if not len(todo):
                break
        return out

    def spelt(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that pieces spell, and where each piece ends in them."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b"", ends
        at = np.arange(ends[-1]) + np.repeat(self.text_starts[ids] - (ends - sizes), sizes)
        return self.text[at].tobytes(), ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that pieces spell, without the space put in front."""
        out = self.spelt(ids)[0]
        return out[1:] if out[:1] == b" " else out


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.a, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros_like(self.a)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


class _Numbers(dict):
    """chunk -> number, in the order of first use."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.new.append(chunk)
        return i

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Lattices:
    """The lattices of chunks. A node is a place in a chunk; its arcs lie together, the longest first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.first, self.last = _Grown(np.int64), _Grown(np.int64)  # of a chunk: its first node and its end
        self.arcs = _Grown(np.int32)  # of a node: its first arc
        self.next, self.id = _Grown(np.int32), _Grown(np.int32)  # of an arc; id below 0: a character spelt in bytes
        self.upto, self.logq, self.others = _Grown(np.float32), _Grown(np.float32), _Grown(np.float32)  # cumulative share, log share, log of the other arcs' share
        self.arcs.add(np.zeros(1, np.int64))

    def of(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk's lattice, new ones built."""
        known, before = self.known, self.first.n
        out = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        new = known.taken()
        for a in range(0, len(new), 20_000):
            self._build(new[a : a + 20_000])
        assert self.first.n == before + len(new)
        return out

    def _build(self, chunks: list[str]) -> None:
        p = self.pieces
        sizes = np.array([len(c) for c in chunks])
        cps = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(cps))  # characters to the end of the chunk
        total, n_chunks = len(cps), len(chunks)
        starts, ids = [], []  # by length, of the pieces that begin at each character
        single = np.zeros(total, dtype=bool)
        alive, h = np.arange(total), np.zeros(total, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, p.longest + 1):
                inside = left[alive] >= n
                alive, h = alive[inside], h[inside]
                if not len(alive):
                    break
                h = (h + cps[alive + n - 1] + np.uint64(1)) * FACTOR
                known = p.lookup(h)
                found = known != NONE
                alive, h, known = alive[found], h[found], known[found]
                whole = known >= 0
                starts.append(alive[whole])
                ids.append(known[whole])
                if n == 1:
                    single[starts[0]] = True
        raw = np.flatnonzero(~single)  # only bytes spell these
        starts[0], ids[0] = np.concatenate([starts[0], raw]), np.concatenate([ids[0], -1 - cps[raw].astype(np.int32)])

        # arcs in the order of their nodes' distance from the end of the chunk, of a node the longest first: mostly the likeliest
        by_rest = np.argsort(left.astype(np.int16) if left.max() < 32768 else left, kind="stable")
        degree = np.bincount(np.concatenate(starts), minlength=total)
        there = degree[by_rest]
        begin = np.cumsum(there) - there
        place = np.empty(total, np.int64)
        place[by_rest] = begin
        head = place.copy()
        n_arcs = int(degree.sum())
        start, length, piece = np.empty(n_arcs, np.int64), np.empty(n_arcs, np.int64), np.empty(n_arcs, np.int32)
        for n in range(len(starts), 0, -1):
            at = place[starts[n - 1]]
            start[at], length[at], piece[at] = starts[n - 1], n, ids[n - 1]
            place[starts[n - 1]] += 1
        cp = -1 - piece
        n_bytes = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        logp = np.where(piece < 0, n_bytes * p.logp[p.byte_ids[0]], p.logp[np.maximum(piece, 0)])
        node = np.arange(total) + np.repeat(np.arange(n_chunks), sizes)  # each chunk has a node more than characters
        to, own = node[start] + length, node[by_rest]
        beta = np.zeros(total + n_chunks)
        cuts = np.append(np.flatnonzero(np.diff(left[by_rest], prepend=0)), total)
        arc_cuts = np.append(begin, n_arcs)[cuts]
        for a, z, x, y in zip(cuts[:-1], cuts[1:], arc_cuts[:-1], arc_cuts[1:]):
            v, heads, many = logp[x:y] + beta[to[x:y]], begin[a:z] - x, there[a:z]
            top = np.maximum.reduceat(v, heads)
            b = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), heads))
            beta[own[a:z]] = b
            logp[x:y] = v - np.repeat(b, many)

        # and in the order of the nodes
        first_arc = np.cumsum(degree) - degree
        at = np.arange(n_arcs) + np.repeat(head - first_arc, degree)
        q = np.minimum(logp[at], 0.0)
        share = np.exp(q)
        sums = np.cumsum(share)
        upto = sums - np.repeat(sums[first_arc] - share[first_arc], degree)
        upto[first_arc + degree - 1] = np.inf
        with np.errstate(divide="ignore"):
            others = np.where(np.repeat(degree, degree) > 1, np.log1p(-np.minimum(share, 1 - 1e-12)), -np.inf)
        base_node, base_arc = self.arcs.n - 1, self.next.n
        per_node = np.zeros(total + n_chunks, np.int64)
        per_node[node] = degree
        self.arcs.add(base_arc + np.cumsum(per_node))
        first = base_node + ends - sizes + np.arange(n_chunks)
        self.first.add(first)
        self.last.add(first + sizes)
        for grown, x in ((self.next, base_node + to[at]), (self.id, piece[at]), (self.upto, upto), (self.logq, q), (self.others, others)):
            grown.add(x)

    def follow(self, node: np.ndarray, last: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from nodes to the ends of their chunks: the number of arcs of each and all arcs, in order."""
        live, at = np.flatnonzero(node < last), node[node < last]
        taken, counts, turn = [], np.zeros(len(node), np.int64), 0
        while len(live):
            u = _uniform(keys[live], places[live] * 65536 + turn)
            arc = self.arcs.a[at].astype(np.int64)
            more = np.flatnonzero(u >= self.upto.a[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] >= self.upto.a[arc[more]]]
            taken.append((live, arc))
            counts[live] += 1
            at = self.next.a[arc].astype(np.int64)
            go = at < last[live]
            live, at, turn = live[go], at[go], turn + 1
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (i, arc) in enumerate(taken):
            out[begin[i] + k] = arc
        return counts, out

    def expand(self, arcs: np.ndarray) -> np.ndarray:
        """The piece ids of arcs, bytes of characters that no piece spells included."""
        return self.expanded(arcs)[0]

    def expanded(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of arcs, and how many each arc has: one, or the bytes of a character that no piece spells."""
        ids = self.id.a[arcs]
        many, raw = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        if not len(raw):
            return ids, many
        spelt = np.frombuffer((-1 - ids[raw]).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        first = np.flatnonzero(spelt & 0xC0 != 0x80)
        many[raw] = np.diff(first, append=len(spelt))
        out = np.repeat(ids, many)
        out[out < 0] = self.pieces.byte_ids[spelt]
        return out, many


class Path:
    """A segmentation of a document: its arcs, the chunk of each, the agenda values of the arcs not taken, its own value."""

    __slots__ = ("arcs", "chunk", "own", "agenda", "value", "logp", "left")


def _valued(lat: Lattices, paths: list[Path], keys: np.ndarray) -> None:
    """Gives segmentations their log probabilities and agendas: the perturbed masses of what each of their own steps leaves, truncated at their values."""
    sizes = np.array([len(q.arcs) for q in paths])
    ends = np.cumsum(sizes)
    begins, arcs = ends - sizes, np.concatenate([q.arcs for q in paths])
    logq = lat.logq.a[arcs].astype(np.float64)
    sums = np.empty(len(arcs))
    for q, a, z in zip(paths, begins, ends):
        np.cumsum(logq[a:z], out=sums[a:z])
        q.logp = float(sums[z - 1]) if z > a else 0.0
    own = np.array([q.own for q in paths])
    place = np.arange(len(arcs)) - np.repeat(begins + own, sizes)
    at = np.flatnonzero(place >= 0)
    of = np.repeat(np.arange(len(paths)), sizes)[at]
    mass = (sums - logq)[at] + lat.others.a[arcs[at]]
    e = -np.log(_uniform(keys[of], place[at]))
    bound = np.array([q.value for q in paths])[of]
    agenda = np.full(len(arcs), -np.inf)
    with np.errstate(over="ignore"):
        agenda[at] = np.where(np.isfinite(mass), mass - np.log(np.exp(np.minimum(mass - bound, 700)) + e), -np.inf)
    for q, a, z in zip(paths, begins, ends):
        q.agenda = agenda[a:z]


def sample_batch(lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text, up to k segmentations: (arcs, log probability, perturbed value, inclusion score)."""
    chunks, sizes = [], []
    for t in texts:
        found = lat.pieces.chunk.findall(" " + t.replace(SPACE, " ")) if t else []
        chunks += found
        sizes.append(len(found))
    number = lat.of(chunks)
    ends = np.cumsum(sizes)
    first, last = lat.first.a[number], lat.last.a[number]
    place = np.arange(len(number)) - np.repeat(ends - sizes, sizes)
    out: list[list[Path]] = [[] for _ in texts]
    nodes = [(None, 0, 0, 0.0)] * len(texts)  # path, step, arc to take there, value; at first the root
    roots = -np.log(-np.log(_uniform(mixed(keys), 0)))
    open_texts, kappa = list(range(len(texts))), np.full(len(texts), -np.inf)
    for turn in range(k + 1):
        if turn:
            still = []
            for d in open_texts:
                paths = out[d]
                best, at = -np.inf, None
                for p in paths:
                    if len(p.agenda) and (v := p.agenda[j := int(p.agenda.argmax())]) > best:
                        best, at = float(v), (p, j)
                if at is None:
                    continue
                kappa[d] = best
                if turn < k:
                    nodes[d] = (*at, _split(lat, *at, best, int(keys[d]), turn), best)
                    still.append(d)
            open_texts = still
            if turn == k:
                break
        # what is left of the document behind each node, as one sample for all of the batch
        with np.errstate(over="ignore"):
            seeds = mixed(keys + np.uint64(turn + 1) * FACTOR)
        heads, starts, tos, whos, places = [], [], [], [], []
        for d in open_texts:
            p, j, arc, _ = nodes[d]
            a, z = ends[d] - sizes[d], ends[d]
            if p is None:
                c0, one = a, first[a:z]
            else:
                c0 = a + int(p.chunk[j])
                one = first[c0:z].copy()
                one[0] = lat.next.a[arc]
            heads.append(c0)
            starts.append(one)
            tos.append(last[c0:z])
            places.append(place[c0:z])
            whos.append(len(one))
        if not open_texts:
            continue
        each = np.repeat(seeds[open_texts], whos)
        counts, arcs = lat.follow(np.concatenate(starts), np.concatenate(tos), each, np.concatenate(places))
        chunk_of = np.repeat(np.concatenate(places), counts)
        per_text = np.add.reduceat(counts, np.cumsum([0, *whos[:-1]])) if len(counts) else np.zeros(len(whos), np.int64)
        per_text = np.where(np.array(whos) > 0, per_text, 0)
        upto = np.cumsum(per_text)
        made = []
        for i, d in enumerate(open_texts):
            p, j, arc, value = nodes[d]
            new = arcs[upto[i] - per_text[i] : upto[i]]
            of = chunk_of[upto[i] - per_text[i] : upto[i]]
            q = Path()
            if p is None:
                q.arcs, q.chunk, q.own, q.value = new, of, 0, float(roots[d])
            else:
                q.arcs, q.chunk = np.concatenate([p.arcs[:j], [arc], new]), np.concatenate([p.chunk[: j + 1], of])
                q.own, q.value = j + 1, value
            q.left = {}
            made.append(q)
            out[d].append(q)
        _valued(lat, made, seeds[open_texts] ^ np.uint64(0xA5A5A5A5))
    found = []
    for d, paths in enumerate(out):
        full = len(paths) == k and np.isfinite(kappa[d])
        found.append([(p.arcs, p.logp, p.value, float(-np.expm1(-np.exp(min(p.logp - kappa[d], 700.0)))) if full else 1.0) for p in paths])
    return found


def _split(lat: Lattices, p: Path, j: int, value: float, key: int, turn: int) -> int:
    """Draws one of the arcs that step j of p left, and puts what still remains back on the agenda."""
    node_arc = int(p.arcs[j])
    node = int(np.searchsorted(lat.arcs.a[: lat.arcs.n], np.int32(node_arc), "right")) - 1
    a, z = int(lat.arcs.a[node]), int(lat.arcs.a[node + 1])
    gone = p.left.setdefault(j, {node_arc})
    arcs = [x for x in range(a, z) if x not in gone]
    q = np.exp(lat.logq.a[arcs].astype(np.float64))
    keys = np.full(1, (key ^ (turn * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    drawn = _uniform(keys, np.array([2 * j + 1, 2 * j + 2]))
    u = drawn[0] * q.sum()
    arc = arcs[min(int(np.searchsorted(np.cumsum(q), u, "right")), len(arcs) - 1)]
    gone.add(arc)
    rest = float(q.sum() - np.exp(lat.logq.a[arc]))
    if len(arcs) > 1 and rest > 0:
        mass = float(lat.logq.a[p.arcs[:j]].sum(dtype=np.float64)) + np.log(rest)
        e = -np.log(drawn[1])
        p.agenda[j] = mass - np.log(np.exp(min(mass - value, 700)) + e)
    else:
        p.agenda[j] = -np.inf
    return arc


def sampled(
    docs: DataFrame,
    model: str,
    k: int = 2,
    seed: int = 17,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = True,
    batch_chars: int = 250_000,
) -> DataFrame:
    """A row per row of docs and segmentation: key, sample (0 the most perturbed), n_pieces, log_prob, perturbed, inclusion, ids_crc32, round_trip,
    and ids if asked for. model: a path that every executor has."""
    import zlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(Pieces(model))
        none = np.zeros(0, np.int32)
        for b in batches:
            all_keys = b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes, a = pc.binary_length(b.column(1)).to_pylist(), 0
            while a < len(sizes):
                z, held = a, 0
                while z < len(sizes) and (z == a or held + sizes[z] <= batch_chars):
                    held, z = held + sizes[z], z + 1
                raw = b.column(1).slice(a, z - a).to_pylist()
                if lat.arcs.n > KNOWN_NODES:
                    lat.clear()
                keys = mixed(all_keys[a:z] ^ mixed(np.full(z - a, seed, np.uint64)))
                found = sample_batch(lat, [t.decode() for t in raw], keys, k)
                segments = [(i, s, *x) for i, of in enumerate(found) for s, x in enumerate(of)]
                at, number, arcs, logp, value, inclusion = zip(*segments)
                ids, lengths = lat.expanded(np.concatenate(arcs))
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, arcs)])]
                said, upto = lat.pieces.spelt(ids)
                cuts = np.concatenate([[0], upto])[ends].tolist()
                plain = [t.replace(SPACE.encode(), b" ") for t in raw]
                crcs, same, le = [], [], ids.astype("<i4")
                for i, a0, z0, x, y in zip(at, ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1], cuts[1:]):
                    crcs.append(zlib.crc32(le[a0:z0]))
                    same.append(said[x + (said[x : min(x + 1, y)] == b" ") : y] == plain[i])
                n_ids = np.diff(ends)
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                cols = zip((number, n_ids, logp, value, inclusion, crcs, same), kinds)
                kept = list_array(ids, n_ids, pa.int32()) if with_ids else list_array(none, np.zeros(len(at), np.int64), pa.int32())
                out = [b.column(0).take(pa.array(np.array(at) + a, pa.int64())), *(pa.array(c, t) for c, t in cols), kept]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32", "round_trip", "ids"])
                a = z

    found = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    out = found.mapInArrow(freed(rows), "doc_id bigint, sample int, n_pieces bigint, log_prob double, perturbed double, inclusion double, ids_crc32 bigint, round_trip boolean, ids array<int>")
    return out if with_ids else out.drop("ids")


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text that their pieces spell; null for null."""
    @F.pandas_udf("string")
    def spell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model)
        for s in parts:
            yield s.map(lambda x: None if x is None else pieces.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace"))

    return rows.withColumn("decoded", spell(F.col(ids)))
