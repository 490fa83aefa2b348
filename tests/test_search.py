"""Exact pruned search and saved inverted files against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import ivf, knn, pruned
from seqloom.storage import stored

DIMS = 6


@pytest.fixture(scope="module")
def frames(spark):
    """Clusters far apart, of several sizes and norms, with repeated vectors, a zero and a null."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(9, DIMS)) * 12
    x = centers[rng.integers(0, 9, 900)] * rng.uniform(0.85, 1.2, (900, 1)) + rng.normal(size=(900, DIMS))
    x[50:60], x[70] = x[40:50], 0
    rows = [(i, i % 3 if i % 50 else None, "mf"[i % 2], None if i == 80 else [float(v) for v in x[i]]) for i in range(900)]
    return spark.createDataFrame(rows, "frame_id bigint, phone int, gender string, feature array<double>").cache()


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "pool_id", "score").collect())


@pytest.mark.parametrize(("metric", "keys", "self_"), [("l2", ["phone"], True), ("cosine", [], False), ("dot", ["phone", "gender"], True)])
def test_pruned_search_gives_the_same_rows(frames, metric, keys, self_):
    want = ranked(knn.nearest(frames, frames, keys, 4, metric, exclude_self=self_))
    rows, report = pruned.search(frames, frames, keys, 4, metric, exclude_self=self_, block_rows=16, cells=12)
    assert ranked(rows) == want
    facts = report.first()
    n = frames.filter("feature is not null")
    n = n.groupBy(*keys).count().dropna().agg(F.sum(F.col("count") ** 2)).first()[0] if keys else n.count() ** 2
    assert facts["possible"] == n and facts["compared"] < 0.6 * n


def test_pruned_search_as_a_retrievers_search(frames):
    some = frames.filter("frame_id % 9 = 0")
    plain, other = (knn.gender_retriever(some, frames) if not c else knn.ladder(some, frames, [["gender"], []], 1, cells=c) for c in (0, 8))
    assert other.count() == plain.filter("found").count()
    assert knn.nearest(frames.limit(0), frames, ["phone"], 3, cells=4).count() == 0
    assert knn.nearest(some, frames.limit(0), ["phone"], 3, cells=4).count() == 0
    few = ranked(knn.nearest(some, frames.filter("frame_id < 5"), [], 9, "l2", cells=4))
    assert few == ranked(knn.nearest(some, frames.filter("frame_id < 5"), [], 9, "l2"))


def test_bounds_hold(frames):
    rng = np.random.default_rng(1)
    groups = [rng.normal(size=(20, DIMS)) * rng.uniform(0.1, 2) + rng.normal(size=DIMS) * 4 for _ in range(12)]
    norms = [np.linalg.norm(g, axis=1) for g in groups]
    facts = {"center": np.stack([g.mean(0) for g in groups]), "radius": np.array([np.linalg.norm(g - g.mean(0), axis=1).max() for g in groups])}
    facts |= {"low": np.array([n.min() for n in norms]), "high": np.array([n.max() for n in norms])}
    for metric in ("l2", "dot"):
        real = np.array([[knn._scores(a, b, metric).min() for b in groups] for a in groups])
        bound = pruned.least(facts, facts, metric)
        assert (bound <= real + 1e-9).all() and (real - bound)[~np.eye(12, dtype=bool)].min() < abs(real).max()


def test_saved_index(spark, frames, tmp_path):
    path = f"file://{tmp_path}/index"
    ivf.save(frames, path, ["gender"], most=8, flat_below=100)
    index = ivf.load(spark, path)
    counts = {r["gender"]: r["n"] for r in index.centers.groupBy("gender").agg(F.count("*").alias("n")).collect()}
    assert counts == {"m": 8, "f": 8} and index.rows.count() == 899
    exact = ranked(knn.nearest(frames, frames, ["gender"], 3, exclude_self=True))
    assert ranked(ivf.search(index, frames, 3, 8, exclude_self=True)) == exact
    probes = ivf.probes_for(index, frames, 3, 0.9, exclude_self=True)
    found = ranked(ivf.search(index, frames, 3, probes, exclude_self=True))
    assert probes < 8 and len({r[:3] for r in found} & {r[:3] for r in exact}) >= 0.9 * len(exact)
    plan = ivf.search(index, frames.filter("frame_id = 3"), 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan
    assert ivf.search(index, frames.filter("frame_id = 3"), 3, 1).count() == 3


def test_small_keys_are_flat_and_few_rows_have_no_index(spark, frames, tmp_path):
    path = f"file://{tmp_path}/index"
    ivf.save(frames.filter("phone <> 2 or frame_id < 30"), path, ["phone"], flat_below=200, least=20)
    index = ivf.load(spark, path)
    assert {r["phone"]: r["n"] for r in index.centers.groupBy("phone").agg(F.count("*").alias("n")).collect()} == {0: 17, 1: 17}
    ivf.save(frames.filter("phone = 2"), path, ["phone"], flat_below=1000)
    index = ivf.load(spark, path)
    assert index.centers.count() == 1
    assert ranked(ivf.search(index, frames, 2, 1)) == ranked(knn.nearest(frames.filter("phone = 2"), frames.filter("phone = 2"), ["phone"], 2))


def test_blocks_meet_in_many_partitions(spark, frames):
    """Partitions of their own for all blocks, as large tables have them; keys of another whole type on one side."""
    rows = {r["frame_id"]: (r["phone"], np.array(r["feature"])) for r in frames.filter("phone is not null and feature is not null").collect()}
    want = {}
    for i, (phone, x) in rows.items():
        near = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 6), j) for j, (other, y) in rows.items() if other == phone and j != i)
        want[i] = [j for _, j in near[:2]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for pool in (frames, frames.withColumn("phone", F.col("phone").cast("bigint"))):
            for block_rows in (2048, 50):
                found: dict = {}
                for q, rank, p, _ in ranked(knn.nearest(frames, pool, ["phone"], 2, "l2", exclude_self=True, block_rows=block_rows)):
                    found.setdefault(q, []).append(p)
                assert found == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies_meet_few_units(spark):
    """Points of a plane, each of them twenty times: units are compact, so most pairs are left out, and copies are 0 apart."""
    rng = np.random.default_rng(3)
    plane = np.round(rng.uniform(900, 2000, (60, 2)), 2)
    rows = [(i, [float(v) for v in plane[i % 60]]) for i in range(1200)]
    points = spark.createDataFrame(rows, "frame_id bigint, feature array<double>")
    found, report = pruned.search(points, points, [], 4, "l2", exclude_self=True, block_rows=16, cells=4)
    got: dict = {}
    for q, _, p, score in ranked(found):
        got.setdefault(q, []).append((p, score))
    assert got == {i: [(j, 0.0) for j in range(i % 60, 1200, 60) if j != i][:4] for i in range(1200)}
    assert report.first()["share"] < 0.1


def test_pieces_are_bounded_and_close():
    x = np.random.default_rng(4).normal(size=(1000, 2))
    piece = pruned.pieces(x, 50)
    sizes = np.bincount(piece)
    assert sizes.max() <= 50 and sizes.sum() == 1000
    assert np.mean([np.ptp(x[piece == i], axis=0).max() for i in range(len(sizes))]) < np.ptp(x, axis=0).max() / 3
    assert np.bincount(pruned.pieces(np.zeros((99, 3)), 10)).max() <= 10


def test_recall_is_measured_on_every_twentieth_row(spark, monkeypatch):
    from seqloom.plans import catalog

    seen, plain = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda queries, *a, **how: seen.append(queries) or plain(queries, *a, **how))
    assert catalog.knn_cells_recall(spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9
    assert len(seen) == 2 and all(q.filter("frame_id % 20 <> 0").isEmpty() and q.select("frame_id").distinct().count() == 25 for q in seen)


def test_index_search_sends_a_query_once_a_group_of_cells(spark, frames, tmp_path, monkeypatch):
    """Not once a cell; groups and blocks of any size give the same rows, for some cells and for all."""
    path, sent = f"file://{tmp_path}/index", []
    ivf.save(frames, path, ["gender"], most=8, flat_below=100)
    index = ivf.load(spark, path)

    def counted(df, name, *a, **how):
        out = stored(df, name, *a, **how)
        sent.extend([out.count()] if name == "probed" else [])
        return out

    monkeypatch.setattr(ivf, "stored", counted)
    exact = ranked(knn.nearest(frames, frames, ["gender"], 5, exclude_self=True))
    assert ranked(ivf.search(index, frames, 5, 8, exclude_self=True)) == exact
    assert sent == [899]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranked(ivf.search(index, frames, 5, 8, exclude_self=True, block_rows=40)) == exact
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(ivf, "HELD_PAIRS", 64)
    monkeypatch.setattr(ivf, "PAIR_COLUMNS", 16)
    assert ranked(ivf.search(index, frames.withColumn("gender", F.col("gender").cast("string")), 5, 8, exclude_self=True, block_rows=150)) == exact
    centers = {(r["gender"], r["cell"]): np.array(r["center"]) for r in index.centers.collect()}
    cells = {r["frame_id"]: r["cell"] for r in index.rows.select("frame_id", "cell").collect()}
    rows = {r["frame_id"]: (r["gender"], np.array(r["feature"])) for r in frames.filter("feature is not null").collect()}
    for r in ivf.search(index, frames.filter("frame_id < 30"), 2, 3, metric="l2", exclude_self=True, block_rows=150).filter("rank = 1").collect():
        g, v = rows[r["query_id"]]
        near = sorted(range(8), key=lambda c: (round(float(((v / (np.linalg.norm(v) + 1e-8) - centers[g, c]) ** 2).sum()), 9), c))[:3]
        best = min((round(float(np.linalg.norm(v - w)), 6), i) for i, (h, w) in rows.items() if h == g and i != r["query_id"] and cells[i] in near)
        assert (r["score"], r["pool_id"]) == best
