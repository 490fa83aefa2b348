"""Repair of conversations by the cheapest edits that make their roles an optional system turn and then user and assistant by turns.

Rows have faults (blank, duplicate, truncated). Keep costs 0, rerole 2, delete 3 (the only edit of blank and duplicate rows), insert of an empty turn 2; a
truncated row that stays adds 1. Of the cheapest edits the initials that come first in ASCII win. The roles so far are one of four states
(nothing, system, user, assistant), so the rest of a conversation costs the same whatever led to its state.

The dynamic program runs over tensors: conversations of one length are a bucket, laid out by time, and each step takes a turn of all of them
at once, from the last to the first (`backward`), keeping what the rest costs from each state; then one pass forward picks the edits
of all of them (`forward`). A conversation of more than CHUNK turns is cut into pieces, so none is ever whole in a task: a
piece's costs from state to state are a 4 x 4 matrix, the matrices are chained by conversation, and each piece, then knowing what follows it, is
traced from all four states, of which the one that the pieces before lead to is taken.

Tables: `faults` (a row a turn), `edits` (a row an edit, with what it leaves: the operator's result), `audited` (a row a conversation).

Defined results: a null role or text is one space; a null turn comes before others; rows with equal turns go by role, then by the
text's first 64 characters, then by its SHA-256; a null
conv_id is a conversation; a role counts by its first character, other initials than s, u, a fit nowhere; further columns are
ignored; an empty table gives an empty result; a conversation all of whose rows go has an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import spread_join, stored
from seqloom.storage import positioned

#: Turns of a conversation that a task holds at once.
CHUNK = 4_096
#: Turns of all the conversations whose costs are in one tensor.
TENSOR_TURNS = 1 << 20
#: White space, as the base rules have it.
WHITE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: 0 nothing, 1 system, 2 user, 3 assistant. What a user or assistant turn, reroled or inserted, leads to.
PUT = np.array([2, 2, 3, 2])
#: What a kept row of initial s, u, a or another one leads to; 4: it fits nowhere.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: What the end costs in each state.
FAR = 1 << 40
END = np.array([0, FAR, FAR, 0])
#: Inserts before a row, as its edit numbers them, and the edits.
INSERTS, KINDS = ("", "u", "a", "ua", "au"), ("D", "K", "Ru", "Ra")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of the rows that are left of (conv_id, turn, role, text): by the CRC-32 of conv_id:turn, modulo 20, 0 drops a row,
    1 empties its text, 2 takes its marks .!? out, 3 repeats it, 4 makes it the user's."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    some = rows.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = some.filter("h <> 0")
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, fault), stored: each row's place in its conversation, from 0, and its first fault."""
    some = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # what rows are ordered by is short, for the driver sees a sample of it
    some = some.withColumns({"__start": F.substring("text", 1, 64), "__sha": F.sha2("text", 256)})
    placed = positioned(some, "conv_id", ["turn", "role", "__start", "__sha"], "turns").drop("__start", "__sha")
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    whose = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    key = F.sha2(F.concat(whose, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = stored(placed.withColumns({"blank": solid == "", "open": ~F.substring(solid, -1, 1).isin(".", "!", "?"), "said": key}), "said")
    again = placed.filter("not blank").groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = spread_join(placed, again, "said", F.xxhash64("pos"))
    repeats = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(repeats, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE)
    return stored(rows.select("conv_id", "turn", "role", "text", "pos", fault.cast("int").alias("fault")), "faults")


def _closed(b: np.ndarray) -> np.ndarray:
    """Costs with up to two inserts before what they were."""
    for _ in range(2):
        b = np.minimum(b, b[..., PUT] + 2)
    return b


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, 4): the least cost of the rest from each state. codes (turns, conversations): initial, 4 if only deletion is allowed, 8 if
    truncated; end (conversations, 4): what follows costs."""
    out = np.empty((len(codes) + 1, *end.shape), dtype=np.int64)
    out[-1] = _closed(end)
    for t in range(len(codes) - 1, -1, -1):
        after, code = out[t + 1], codes[t]
        lengthened = np.concatenate([after, np.full((len(after), 1), FAR)], axis=1)
        stays = np.minimum(np.take_along_axis(lengthened, KEEP[code & 3], 1), after[:, PUT] + 2) + (code >> 3 & 1)[:, None]
        out[t] = _closed(np.minimum(after + 3, np.where((code >> 2 & 1)[:, None] == 1, FAR, stays)))
    return out


def forward(codes: np.ndarray, costs: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, last states) of the cheapest way from the states on, the first in ASCII: D, I, K, R. edits (turns + 1, conversations): 4 times the inserts
    before the row, and the row's edit, as numbers."""
    who, out = np.arange(len(state)), np.zeros((len(codes) + 1, len(state)), dtype=np.int8)
    for t in range(len(out)):
        put = np.zeros(len(state), dtype=np.int64)
        rest = costs[t + 1] + 3 if t < len(codes) else end
        for _ in range(2):
            inserted = (rest[who, state] != costs[t, who, state]) & (costs[t, who, PUT[state]] + 2 == costs[t, who, state])
            put = np.where(inserted, np.where(put == 0, np.where(state == 2, 2, 1), put + 2), put)
            state = np.where(inserted, PUT[state], state)
        if t == len(codes):
            out[t] = 4 * put
            break
        now, then, code = costs[t, who, state], costs[t + 1], codes[t]
        to = KEEP[code & 3, state]
        dropped = rest[who, state] == now
        kept = ~dropped & (to < 4) & (then[who, np.minimum(to, 3)] + (code >> 3 & 1) == now)
        out[t] = 4 * put + np.where(dropped, 0, np.where(kept, 1, np.where(state == 2, 3, 2)))
        state = np.where(dropped, state, np.where(kept, to, PUT[state]))
    return out, state


def _buckets(t: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, codes by time) for each length, of TENSOR_TURNS turns at most."""
    lists = t.column(column)
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        bucket = np.flatnonzero(sizes == n)
        most = max(1, TENSOR_TURNS // (n + 1))
        for rows in (bucket[i : i + most] for i in range(0, len(bucket), most)):
            yield rows, flat[starts[rows][None, :] + np.arange(n)[:, None]].astype(np.int64)


def _matrices(pieces: DataFrame) -> DataFrame:
    """(conv_id, chunk, matrix): what each piece costs from state to state, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((len(b), 4, 4), dtype=np.int64)
            for rows, codes in _buckets(b, "codes"):
                for to in range(4):
                    end = np.full((len(rows), 4), FAR)
                    end[:, to] = 0
                    out[rows, :, to] = backward(codes, end)[0]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), pa.array(list(out.reshape(len(b), 16)), pa.list_(pa.int64()))], ["conv_id", "chunk", "matrix"])

    kind = dict(pieces.dtypes)["conv_id"]
    return pieces.mapInArrow(run, f"conv_id {kind}, chunk bigint, matrix array<bigint>")


def _ends(matrices: DataFrame) -> DataFrame:
    """(conv_id, chunk, rest): what follows each piece costs from each state. A group is sixteen numbers a piece."""

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by([("chunk", "descending")])
        rest, out = END, []
        for m in t.column("matrix").to_pylist():
            out.append(rest)
            rest = np.minimum((np.array(m).reshape(4, 4) + rest).min(1), FAR)
        return pa.table([t.column("conv_id"), t.column("chunk"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=["conv_id", "chunk", "rest"])

    kind = dict(matrices.dtypes)["conv_id"]
    return matrices.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, chunk bigint, rest array<bigint>")


def _traced(pieces: DataFrame) -> DataFrame:
    """(conv_id, chunk, state, last, edits): each piece's edits from state 0, or, of pieces with `rest`, from each state, and the state that they end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = b.column("rest").is_valid().to_numpy(zero_copy_only=False)
            whole = np.tile(END, (len(b), 1))
            if cut.any():
                whole[cut] = np.array([x for x in b.column("rest").to_pylist() if x is not None])
            found = []
            for rows, codes in _buckets(b, "codes"):
                costs = backward(codes, whole[rows])
                for state in range(4):
                    own = np.flatnonzero(cut[rows] | (state == 0))
                    if len(own):
                        edits, last = forward(codes[:, own], costs[:, own], whole[rows[own]], np.full(len(own), state))
                        found += [(r, state, z, e) for r, z, e in zip(rows[own].tolist(), last.tolist(), edits.T)]
            at = pa.array([x[0] for x in found], pa.int64())
            own = [pa.array([x[i] for x in found], k) for i, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int8())))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(at), b.column("chunk").take(at), *own], ["conv_id", "chunk", "state", "last", "edits"])

    kind = dict(pieces.dtypes)["conv_id"]
    return pieces.mapInArrow(run, f"conv_id {kind}, chunk bigint, state int, last int, edits array<tinyint>")


def _led_to(traced: DataFrame) -> DataFrame:
    """(conv_id, chunk, state): the state that the pieces before lead to. A group is four states a piece."""

    def chain(t: pa.Table) -> pa.Table:
        last = {(c, s): z for c, s, z in zip(*(t.column(c).to_pylist() for c in ("chunk", "state", "last")))}
        states, state = [], 0
        for c in range(max(c for c, _ in last) + 1):
            states.append(state)
            state = last[c, state]
        columns = [pa.array([t.column("conv_id")[0].as_py()] * len(states), t.schema.field("conv_id").type), pa.array(range(len(states)), pa.int64()), pa.array(states, pa.int32())]
        return pa.table(columns, names=["conv_id", "chunk", "state"])

    kind = dict(traced.dtypes)["conv_id"]
    return traced.select("conv_id", "chunk", "state", "last").groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, chunk bigint, state int")


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on keys that may be null, which only left keeps."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in keys})
    return left.join(named, reduce(Column.__and__, (left[c].eqNullSafe(named[f"__{c}"]) for c in keys)), how).drop(*(f"__{c}" for c in keys))


def numbered_edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, pos, code): the edit of each row of `faults`, as `forward` numbers it, and a last one behind the rows of each conversation."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = kind + F.when(F.col("fault").isin(BLANK, DUPLICATE), 4).otherwise(0) + F.when(F.col("fault") == TRUNCATED, 8).otherwise(0)
    slim = turns.select("conv_id", "pos", F.floor(F.col("pos") / chunk).alias("chunk"), code.cast("tinyint").alias("code"))
    # a group is a piece, of `chunk` small numbers at most
    pieces = slim.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    pieces = stored(pieces.select("conv_id", "chunk", F.transform("rows", lambda r: r["code"]).alias("codes")), "pieces")
    cut = stored(_met(pieces, pieces.filter("chunk > 0").select("conv_id").distinct(), ["conv_id"], "left_semi"), "long")
    rest = stored(_ends(_matrices(cut)), "rest")
    traced = stored(_traced(_met(pieces, rest, ["conv_id", "chunk"])), "traced")
    long = traced.filter("chunk > 0").select("conv_id").distinct()
    led = _led_to(_met(traced, long, ["conv_id"], "left_semi"))
    chosen = _met(traced, long, ["conv_id"], "left_anti").unionByName(_met(traced, led, ["conv_id", "chunk", "state"], "left_semi"))
    each = chosen.select("conv_id", "chunk", F.size("edits").alias("n"), F.posexplode("edits").alias("i", "code"))
    # behind a piece's rows nothing happens, but for inserts at the end of a conversation
    return each.filter("i < n - 1 or code > 0").select("conv_id", (F.col("chunk") * chunk + F.col("i")).alias("pos"), F.col("code").cast("int").alias("code"))


def edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, pos, sub, edit, role, text, was, fault) in the order of (pos, sub): the cheapest edits. edit: I, D, K or R; role and text: of the turn that
    stays, null for a deletion; was: the row's role before, null for an insert."""
    codes = numbered_edits(turns, chunk)
    both = _met(codes, turns.withColumn("here", F.lit(True)), ["conv_id", "pos"])
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("code") % 4 + 1)
    puts = F.element_at(F.array(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in INSERTS)), F.floor(F.col("code") / 4).cast("int") + 1)
    put = F.transform(puts, lambda x: F.struct(F.lit("I").alias("edit"), name(x).alias("role"), F.lit("").alias("text")))
    stays = kind != "D"
    role = F.when(kind == "K", F.col("role")).when(stays, name(F.substring(kind, 2, 1)))
    own = F.array(F.struct(F.substring(kind, 1, 1).alias("edit"), role.alias("role"), F.when(stays, F.col("text")).alias("text")))
    rows = both.select("conv_id", "pos", "fault", F.col("role").alias("was"), F.concat(put, F.filter(own, lambda x: F.col("here").isNotNull())).alias("e"))
    out = rows.select("conv_id", "pos", "fault", "was", F.posexplode("e").alias("sub", "e"))
    inserted = F.col("e.edit") == "I"
    return out.select("conv_id", "pos", "sub", "e.edit", "e.role", "e.text", F.when(~inserted, F.col("was")).alias("was"), F.when(~inserted, F.col("fault")).alias("fault"))


def audited(found: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations of `edits`. Rows stream by in order, so a task
    keeps no text; of a conversation it keeps one letter an edit."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind, legal = dict(found.dtypes)["conv_id"], {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], object(), None

        def ended() -> list:
            return [] if state is None else [(now, *state["n"], "".join(state["audit"]), state["sha"].hexdigest())]

        def table(key_type) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((key_type, *[pa.int64()] * 5, pa.string(), pa.string()))], names)

        for b in batches:
            for key, edit, role, text, was, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "was", "fault"))):
                if state is None or key != now:
                    out += ended()
                    now, state = key, {"n": [0] * 5, "audit": [], "sha": hashlib.sha256(), "before": None, "some": False}
                n = state["n"]
                state["audit"].append(edit)
                n[4] += {"I": 2, "D": 3, "R": 2, "K": 0}[edit] + (fault == TRUNCATED and edit in "KR")
                if edit != "I":
                    if fault:
                        n[fault - 1] += 1
                    n[3] += state["before"] is not None and state["before"][:1] + was[:1] not in legal
                    state["before"] = was
                if edit != "D":
                    state["sha"].update(("\n" * state["some"] + role + ":" + text).encode())
                    state["some"] = True
            yield table(b.schema.field("conv_id").type)
            key_type, out = b.schema.field("conv_id").type, []
        if state is not None:
            out = ended()
            yield table(key_type)

    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in names[1:]))


def repaired(rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text), and of ids (conv_id): its gaps, faults, costs, audit and repaired digest."""
    turns = faults(rows)
    spread = turns.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = spread.agg((F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("*")).cast("bigint").alias("gaps"))
    out = audited(edits(turns, chunk))
    out = _met(out, gaps, ["conv_id"])
    ids = (turns if ids is None else ids).select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    rest = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")]
    return _met(ids, out, ["conv_id"]).select("conv_id", *zero.values(), *rest)
