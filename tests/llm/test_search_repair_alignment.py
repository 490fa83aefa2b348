"""Collision search, conversation repair and token alignment against brute force, and their edge cases."""

import collections
import functools
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import collision_search, conversation_repair, queries, token_alignment

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, wanted, k):
    """rows: (id, vector); (query position, rank) -> (id, score)."""
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if wanted(i):
            scores = sorted((-float((v * q).sum()), j) for b, (j, v) in enumerate(fine) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def found_rows(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


def recall(got, want):
    """By (query, rank set): the share of the exact neighbours that were found."""
    have = collections.Counter((q, i) for q, _, i, _ in got)
    return sum((collections.Counter((q, i) for q, _, i, _ in want) & have).values()) / len(want)


def test_nearest_query_on_given_rows(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got = found_rows(queries.op11_nearest_neighbours(spark, SF))
    assert len(got) == len(want) and recall(got, want) >= 0.9
    v = {i: np.array(x, dtype=float) for i, x in rows}
    assert all(abs(s - v[q] @ v[i]) < 1e-12 for q, _, i, s in got)
    assert all(a[3] >= b[3] for a, b in zip(sorted(got), sorted(got)[1:]) if a[0] == b[0])


@pytest.mark.parametrize("shard_rows", [100, 16_384])
def test_nearest_on_clusters_of_several_norms(spark, shard_rows):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 24))
    x = centers[rng.integers(0, 12, 1500)] * rng.uniform(0.3, 3, (1500, 1)) + 0.2 * rng.standard_normal((1500, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found_rows(collision_search.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0, 10, shard_rows=shard_rows))
    assert recall(got, brute_nearest(rows, lambda i: i % 20 == 0, 10)) >= 0.93


def test_nearest_leaves_out_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0])]
    rows += [(None, [1.0, 1.0]), (40, [1.0, 1.0]), (9, [1.0, 1.0]), (8, [1.0, 1.0]), (2, [1.0, 2.0, 3.0]), (-20, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id bigint, embedding array<double>, row string, score double")
    want = brute_nearest([r for r in rows if r[0] != 2], lambda i: i % 20 == 0, 3)
    assert sorted(found_rows(collision_search.search(df, F.col("id") % 20 == 0, 3, target=1 - 1e-9))) == sorted(want)
    all_ = brute_nearest([r for r in rows if r[0] != 2], lambda i: i % 20 == 0, 99)
    assert sorted(found_rows(collision_search.search(df, F.col("id") % 20 == 0, 99, shard_rows=3, block_queries=2))) == sorted(all_)
    assert found_rows(collision_search.search(df.filter("vec_id = 0"), F.col("id") % 20 == 0)) == []
    assert found_rows(collision_search.search(df.limit(0), F.col("id") % 20 == 0)) == []
    assert found_rows(collision_search.search(df, F.col("id") == 77)) == []


def test_collision_threshold_prunes(spark):
    """Near vectors collide often, far ones rarely: clusters apart are not verified."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 32))[np.repeat(np.arange(40), 50)] + 0.01 * rng.standard_normal((2000, 32))
    how = collision_search.Settings(32, float(np.linalg.norm(x, axis=1).max()))
    keys, q = how.projected(x), how.projected_queries(x[:1])
    d = how.distances((x @ x[0]) / np.linalg.norm(x[0]))
    hits = (np.abs(keys - q) <= how.reach * np.sort(d)[20]).sum(0)
    near = np.argsort(d)[1:21]
    assert (hits[near] >= how.threshold).mean() > 0.9 and (hits[50:] >= how.threshold).mean() < 0.1


LEGAL = {"su", "ua", "au"}
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def brute_repair(rows):
    """One conversation's (turn, role, text), by suffixes of whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))

    @functools.cache
    def best(t, state, inserts=0):
        options = []
        if t == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 2:
            to = "a" if state == "u" else "u"
            c, a, lines = best(t, to, inserts + 1)
            options.append((c + 2, "I" + a, ({"u": "user", "a": "assistant"}[to] + ":", *lines)))
        if t < len(rows):
            _, role, text = rows[t]
            c, a, lines = best(t + 1, state)
            options.append((c + 3, "D" + a, lines))
            if faults[t] not in (1, 2):
                more = faults[t] == 3
                if (state, role[:1]) in AFTER:
                    c, a, lines = best(t + 1, AFTER[state, role[:1]])
                    options.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                to = "a" if state == "u" else "u"
                c, a, lines = best(t + 1, to)
                options.append((c + 2 + more, "R" + a, ({"u": "user", "a": "assistant"}[to] + ":" + text, *lines)))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, "")
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_repaired(rows):
    of = collections.defaultdict(list)
    for conv, *rest in brute_damage(rows):
        of[conv].append(tuple(rest))
    return {conv: brute_repair(of[conv]) for conv in {r[0] for r in rows}}


def repaired(df, chunk):
    out = conversation_repair.repaired(conversation_repair.damaged(df), df, chunk).collect()
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out}


@pytest.fixture(scope="module")
def odd_turns():
    rng = np.random.default_rng(8)
    roles, said = ["user", "assistant", "system", "tool", None, "", "a"], ["Well.", "No", None, "", " \n", "Yes!", "what? \t", "naïve é.", "…"]
    rows = [(c, int(t), str(rng.choice(roles[:4])) if rng.random() < 0.9 else roles[rng.integers(4, 7)], said[rng.integers(0, 9)]) for c in range(60) for t in range(rng.integers(1, 14))]
    rows += [(60, None, "user", "Twice."), (60, None, "assistant", "Nulls."), (60, 7, "user", "x" * 300_000), (60, 9, "assistant", "y." * 200_000), (None, 1, "user", "Whose?"), (None, None, None, None)]
    rows += [(61, t, "user", "Same.") for t in range(30)] + [(62, -(2**62), "system", "Far."), (62, 2**62, "user", "Apart.")] + [(63, t, "au"[t % 2], f"{t}.") for t in range(50)]
    rows += [(64, 5, "system", "Alone.")] + [(65, 3, "user", "Again.")] * 3
    return rows


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair_against_brute_force(spark, odd_turns, chunk):
    rows = [(*r, "x", 0) for r in odd_turns]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, pos int").repartition(3)
    assert repaired(df, chunk) == brute_repaired(odd_turns)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repaired(df, 4096) == {}
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "All of it goes.")], df.schema), 4096) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = queries.op12_conversation_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute_repaired(rows)


def test_edits_rebuild_the_audit(spark, odd_turns):
    """The operator's own table: an edit a row, whose turns that stay have the wanted roles."""
    df = spark.createDataFrame(odd_turns, "conv_id bigint, turn bigint, role string, text string")
    rows = conversation_repair.edits(conversation_repair.faults(df), 5).collect()
    of = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["pos"], r["sub"])):
        of[r["conv_id"]].append(r)
    for own in of.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own if r["edit"] != "D"))
        assert all((r["was"] is None) == (r["edit"] == "I") and (r["text"] is None) == (r["edit"] == "D") for r in own)


def brute_alignment(rows):
    a, b = token_alignment.tokenizers(queries.BYTE_BPE, queries.PIECE_MODEL)
    pairs, found = collections.Counter(), []
    for i, text in rows:
        groups, links = [], []
        x = a.slow.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.model.encode(text or "")
        ends = []
        for ids, tokens in ((x, a), (y, b)):
            at, own = 0, []
            for t in ids:
                at += len(tokens.bytes[t])
                own.append(at)
            ends.append(own)
        spelt = [b"".join(t.bytes[k] for k in ids) for ids, t in ((x, a), (y, b))]
        if not text or spelt != [(" " + text).encode()] * 2:
            found.append((i, 0, 0, 0, [], ""))
            continue
        now = ([], [])
        u = v = 0
        while u < len(x) or v < len(y):
            if v == len(y) or u < len(x) and ends[0][u] <= ends[1][v]:
                now[0].append(x[u])
                end, u = ends[0][u], u + 1
            else:
                now[1].append(y[v])
                end, v = ends[1][v], v + 1
            if u and v and ends[0][u - 1] == ends[1][v - 1]:
                groups.append(now)
                links.append((now[0][-1], now[1][-1]))
                now = ([], [])
        pairs.update(links)
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((i, len(x), len(y), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    top = collections.defaultdict(int)
    for (_, v), n in pairs.items():
        top[v] = max(top[v], n)
    return sorted(((i, n, m, g, len(ls), sum(pairs[x] == top[x[1]] for x in ls), sum(pairs[x] for x in ls), sha) for i, n, m, g, ls, sha in found), key=str)


ODD = [None, "", " ", "  two  spaces ", "<|endoftext|> and <s></s><unk><0x41>", "a▁b", "naïve ﬁ １２３ é́", "\x00\x01", "日本語 テキスト 🙂🙂", "\r\n\t x", "don't we'll", "The same words.", "The same words.", " " * 5000 + "x", "w" * 20000]


@pytest.mark.parametrize("long", [1 << 20, 50])
def test_alignment_against_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(token_alignment, "LONG", long)
    monkeypatch.setattr(token_alignment, "HELD_KEYS", 40)
    rng = np.random.default_rng(4)
    words = ["alpha", "beta,", "Gamma", "x1", "é", "stone.", "the", "\n", "7", "don't"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(words, rng.integers(1, 200)))) for i in range(40)] + [(None, "no name"), (3, "again three")]
    df = spark.createDataFrame([(*r, "k", [1]) for r in rows], "doc_id bigint, text string, keys string, a array<int>").repartition(3)
    got = token_alignment.with_counts(df, queries.BYTE_BPE, queries.PIECE_MODEL).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == brute_alignment(rows)


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_token_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == brute_alignment(rows)


def test_alignment_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_alignment.with_counts(empty, queries.BYTE_BPE, queries.PIECE_MODEL).collect() == []
    text = "Many words stand here, again and again. " * 60_000
    got = token_alignment.with_counts(spark.createDataFrame([(1, text), (2, None)], empty.schema), queries.BYTE_BPE, queries.PIECE_MODEL).collect()
    assert sorted(tuple(r) for r in got) == brute_alignment([(1, text), (2, None)])
    with pytest.raises(FileNotFoundError):
        token_alignment.with_counts(empty, "/no/such/file", queries.PIECE_MODEL)


def test_aligned_tokens_spell_the_text(spark):
    """The operator's own table: ids and group sizes, whose links are those of the fused pass."""
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    rows = token_alignment.aligned(df, queries.BYTE_BPE, queries.PIECE_MODEL)
    a, b = token_alignment.tokenizers(queries.BYTE_BPE, queries.PIECE_MODEL)
    for r in rows.collect():
        assert sum(r["a_sizes"]) == len(r["a"]) and sum(r["b_sizes"]) == len(r["b"]) and len(r["a_sizes"]) == len(r["b_sizes"])
        assert not r["a"] or b"".join(a.bytes[i] for i in r["a"]) == b"".join(b.bytes[i] for i in r["b"]) == (" " + ODD[r["doc_id"]]).encode()
    assert sorted(token_alignment.links(rows).collect()) == sorted(token_alignment.linked_texts(df, queries.BYTE_BPE, queries.PIECE_MODEL).collect())


def test_shards_hold_sorted_keys_on_disk(spark, tmp_path):
    rng = np.random.default_rng(6)
    keys = (rng.integers(0, 50, 5000) << 32 | rng.integers(0, 40, 5000)).tolist()
    rows = spark.createDataFrame([(k, 1) for k in keys], "key bigint, n bigint").repartition(4)
    folder = f"file://{tmp_path}/counts"
    manifest = token_alignment.count_shards(rows, folder).collect()
    want = collections.Counter(keys)
    assert sum(r["n"] for r in manifest) == len(want) and len(os.listdir(f"{tmp_path}/counts")) == 2 * len(manifest)
    asked = np.array(sorted({*want, 5, 7 << 40}), dtype=np.int64)
    shards = token_alignment.Shards(folder, sorted((r["first"], r["last"], r["n"], r["name"]) for r in manifest))
    assert shards.counts(asked).tolist() == [want.get(int(k), 0) for k in asked]
    assert all(isinstance(x, np.memmap) for pair in shards.open.values() for x in pair)
