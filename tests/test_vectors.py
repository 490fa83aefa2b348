"""Invariants of projections, clustering and nearest-neighbour joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import vec
from seqloom.operators import cluster, knn, linalg, metrics, stats
from seqloom.plans.offline import Offline
from seqloom.plans.online import anonymized

DIMS = 6


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(240, DIMS)) + np.repeat(rng.normal(size=(4, DIMS)) * 4, 60, axis=0)
    rows = [(i, i // 20, i % 20, i // 60, i % 7, "mf"[i % 2], [float(v) for v in x[i]]) for i in range(240)]
    return spark.createDataFrame(rows, "frame_id bigint, utt int, t int, phone int, speaker int, gender string, feature array<double>").cache()


def matrix(df, column="feature"):
    return np.array([r[column] for r in df.orderBy("frame_id").collect()])


def test_projection_is_one(frames):
    basis = linalg.subspace(frames, "speaker", DIMS, 3)["basis"]
    assert np.abs(basis @ basis.T - np.eye(3)).max() < 1e-9
    once = linalg.projected_out(frames, basis)
    twice = linalg.projected_out(once, basis, "cleaned", "again")
    assert np.abs(matrix(twice, "cleaned") - matrix(twice, "again")).max() < 1e-9
    assert np.abs(matrix(once, "cleaned") @ basis.T).max() < 1e-9


def test_pca_against_numpy(frames):
    x = matrix(frames)
    model = linalg.pca(frames, DIMS, 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert model["variance"] == pytest.approx(s[:3] ** 2 / 239)
    got = matrix(linalg.transformed(frames, model, whiten=True), "projected")
    assert got.mean(0) == pytest.approx(0, abs=1e-9) and got.std(0, ddof=1) == pytest.approx(1)


def test_ridge_against_numpy(frames):
    d = frames.select("utt").distinct().withColumn("d", F.array((F.col("utt") % 5).cast("double"), (F.col("utt") % 3).cast("double")))
    model = linalg.ridge(linalg.ridge_statistics(frames, d, dims=DIMS), 2, DIMS)
    u = np.arange(240) // 20
    z = np.stack([u % 5, u % 3, np.ones(240)], 1)
    want = np.linalg.solve(z.T @ z + 2e-4 * np.eye(3), z.T @ matrix(frames))
    assert model["A"] == pytest.approx(want[:2]) and model["b"] == pytest.approx(want[2])
    assert matrix(linalg.eta(frames, d, model), "eta") == pytest.approx(matrix(frames) - z @ want)


def test_blocks_do_not_change_neighbours(frames):
    whole, cut = (sorted(knn.nearest(frames, frames, ["phone"], 3, "l2", block_rows=b).collect()) for b in (1000, 7))
    assert whole == cut and len(whole) == 720
    assert all(r["pool_id"] == r["query_id"] for r in whole if r["rank"] == 1)
    x, phone = matrix(frames), np.arange(240) // 60
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 6)
    d[phone[:, None] != phone[None]] = np.inf
    assert [r["pool_id"] for r in whole if r["rank"] == 2] == list(np.argsort(d, axis=1, kind="stable")[:, 1])


def test_ladder(frames):
    pool = frames.filter("phone = 0 AND gender = 'm' OR phone = 1")
    level = {r["query_id"]: r["level"] for r in knn.ladder(frames, pool, [["phone", "gender"], ["phone"], ["gender"]], 1).collect()}
    assert (level[0], level[1], level[60], level[130]) == (0, 1, 0, 2)
    alone = knn.cluster_retriever(frames, pool.select("phone", "gender", F.col("frame_id").alias("center_id"), F.col("feature").alias("center")))
    assert alone.filter("not found").count() == 120


def test_soft_keys_apply_in_turn(frames):
    pool = frames.filter("frame_id < 70")
    mask = {r["frame_id"]: r["mask"] for r in knn.soft_levels(frames, pool, ["gender"], ["phone", "speaker"], 4).collect()}
    assert mask[0] == 3 and mask[62] == 1 and mask[130] == 2


def test_softmax_is_between_its_neighbours(frames):
    found = knn.nearest(frames, frames, ["phone"], 1)
    assert matrix(knn.softmax_of(found, frames, DIMS).withColumnRenamed("query_id", "frame_id"), "vector") == pytest.approx(matrix(frames))
    drawn = knn.picked(knn.nearest(frames, frames, ["phone"], 5), 2)
    assert drawn.count() == 480 and knn.picked(drawn, 3, replace=True).count() == 720


def test_centers_do_not_depend_on_partitions(frames):
    a, b = (sorted(cluster.group_centers(f, ["phone"], 3).collect()) for f in (frames, frames.repartition(5)))
    assert a == b and len(a) == 12
    assert cluster.codebook(frames, 5) == pytest.approx(cluster.codebook(frames.repartition(3), 5))


@pytest.mark.parametrize("keys", [["phone"], ["phone", "other"]])
def test_large_groups_are_fitted_whole(frames, keys):
    f = frames.filter("phone > 0 OR frame_id % 2 = 0").withColumn("other", F.when(F.col("phone") > 1, F.lit("x")))
    order = lambda df: sorted(df.collect(), key=lambda r: (r["phone"], r["center_no"]))
    for more in ({}, {"few": "shrink", "least": 1}, {"few": "raw", "least": 45}):
        one, many = (order(cluster.group_centers(f, keys, 3, fit_rows=n, **more)) for n in (1000, 20))
        some = order(cluster.group_centers(f, keys, 3, fit_rows=40, **more))
        for got in (many, some):
            assert [(r["phone"], r["center_no"], r["n"]) for r in got] == [(r["phone"], r["center_no"], r["n"]) for r in one]
            assert np.array([r["center"] for r in got]) == pytest.approx(np.array([r["center"] for r in one]))
    assert {(r["phone"], r["n"]) for r in one} == {(0, 30), (1, 60), (2, 60), (3, 60)}
    protos = [sorted(cluster.prototypes(frames, 20, DIMS, fit_rows=n).collect(), key=lambda r: (r["speaker"], r["phone"], r["center_no"])) for n in (1000, 3)]
    assert np.array([r["center"] for r in protos[1]]) == pytest.approx(np.array([r["center"] for r in protos[0]]))


def test_bank_has_many_speakers_and_falls_back(frames):
    some = cluster.bank(frames, DIMS, clusters=3, per_cluster=5, least_speakers=3)
    assert some.groupBy("phone", "center_no").count().agg(F.max("count")).first()[0] <= 5
    none = cluster.bank(frames, DIMS, clusters=3, least_speakers=99)
    assert none.count() == 180 and none.filter("center_no is not null").count() == 0


def test_entropy_is_a_share(frames):
    e = stats.confusion_entropy(frames, stats.speaker_centroids(frames, DIMS)).select("entropy").collect()
    assert len(e) == 240 and all(0 <= r[0] <= 1 + 1e-6 for r in e)


def test_adain_takes_the_style(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [10.0, 20.0, 60.0])], "a array<double>, b array<double>")
    got = np.array(df.select(vec.adain(F.col("a"), F.col("b"))).first()[0])
    assert got.mean() == pytest.approx(30) and got.std(ddof=1) == pytest.approx(np.std([10, 20, 60], ddof=1))


def test_probe_reads_what_is_there(frames):
    assert metrics.probe_accuracy(frames, "phone") > 0.9 > metrics.probe_accuracy(frames, "gender")


def test_plan_resumes(spark, frames, tmp_path):
    plan = Offline(spark, str(tmp_path), {"dims": DIMS, "speaker_directions": 2, "codes": 4, "clusters": 3})
    with pytest.raises(RuntimeError):
        plan.run(["subspace"])
    frames.write.parquet(plan.path("frames"))
    assert set(plan.run().values()) == {"done"} and set(plan.run().values()) == {"kept"}
    assert plan.table("pool").count() == 240
    out = anonymized(frames.withColumn("long", F.lit(4.0)), plan.table("centers"), plan.matrix("subspace"), mode="cross", predicted="long", duration_weight=1.0)
    assert out.groupBy("utt").count().filter("count = 4").count() == 12


def test_lda_and_content_directions_against_numpy(frames):
    x, phone = matrix(frames), np.arange(240) // 60
    mean = x.mean(0)
    between = sum(60 * np.outer(x[phone == p].mean(0) - mean, x[phone == p].mean(0) - mean) for p in range(4))
    within = sum((x[phone == p] - x[phone == p].mean(0)).T @ (x[phone == p] - x[phone == p].mean(0)) for p in range(4))
    values = np.sort(np.linalg.eigvals(np.linalg.inv(within + 1e-6 * np.eye(DIMS)) @ between).real)[::-1]
    rows = linalg.lda(frames, DIMS, "phone", 3)
    for r, v in zip(rows, values):
        assert between @ r == pytest.approx(v * (within + 1e-6 * np.eye(DIMS)) @ r, abs=1e-6)
    # what the labels don't tell has no spread between them: the means of the phones' directions stand in
    flat = frames.withColumn("feature", F.array(*(F.lit(float("nan")) for _ in range(DIMS))))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.subspace(flat, "phone", DIMS, 2)
    content = linalg.content_subspace(frames, 5, DIMS)
    means = np.stack([x[phone == p].mean(0) if p < 4 else np.zeros(DIMS) for p in range(5)])
    s = np.linalg.svd(means - means.mean(0), compute_uv=False)
    share = np.cumsum(s**2) / (s**2).sum()
    assert len(content["basis"]) == min(int(np.searchsorted(share, 0.95)) + 1, 4)
    two = linalg.balanced_content_subspace(frames, DIMS, per_class=25)
    assert two["basis"].shape == (2, DIMS) and two["basis"] @ two["basis"].T == pytest.approx(np.eye(2), abs=1e-9)
    assert linalg.balanced_content_subspace(frames, DIMS, use_lda=True)["basis"].shape == (2, DIMS)
    assert linalg.balanced_content_subspace(frames.filter("phone < 2"), DIMS)["basis"].shape == (0, DIMS)


def test_unit_pca_and_energy(frames):
    x = matrix(frames)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    model = linalg.pca(frames, DIMS, 3, unit=True)
    assert model["variance"] == pytest.approx(np.linalg.svd(u - u.mean(0), compute_uv=False)[:3] ** 2 / 239)
    z = (u - u.mean(0)) @ model["components"].T / np.sqrt(model["variance"])
    want = np.concatenate([z, 2.0 * x[:, :2]], 1)
    got = matrix(linalg.with_energy(frames.withColumn("e", F.slice("feature", 1, 2)), model, "e", 2.0), "style")
    assert got == pytest.approx(want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-8))


def test_sanity_gate(frames, spark):
    basis = linalg.subspace(frames, "phone", DIMS, 2)["basis"]
    cleaned = linalg.component(linalg.projected_out(frames, basis))
    assert matrix(cleaned) == pytest.approx(matrix(cleaned, "cleaned") + matrix(cleaned, "component"))
    facts = metrics.separation(cleaned, "feature", "cleaned").first()
    assert facts["mean_dot"] < 1e-9 and 0 < facts["style_share"] < 1
    said = spark.createDataFrame([(0.3, 0), (0.6, 0), (0.9, 0), (0.3, 1)], "r double, n int").select(metrics.gate(F.col("r"), F.col("n")))
    assert [r[0] for r in said.collect()] == ["go", "caution", "reconsider", "blocked"]


def plain_kmeans(x, k, steps=20):
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        code = np.array([np.argmin(np.round([((v - u) ** 2).sum() for u in c], 9)) for v in x])
        new = np.stack([x[code == i].mean(0) if (code == i).any() else c[i] for i in range(k)])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return c


def test_centers_against_plain_kmeans(frames):
    x = matrix(frames)
    got = cluster.group_centers(frames, ["phone"], 3).orderBy("phone", "center_no").collect()
    for p in range(4):
        assert np.array([r["center"] for r in got if r["phone"] == p]) == pytest.approx(plain_kmeans(x[60 * p : 60 * p + 60], 3))
    rows = cluster.assigned(frames, cluster.group_centers(frames, ["phone"], 3), ["phone"]).collect()
    assert len(rows) == 240
    for r in rows:
        d = [np.linalg.norm(np.array(c["center"]) - x[r["frame_id"]]) for c in got if c["phone"] == r["phone"]]
        assert r["center_no"] == int(np.argmin(np.round(np.square(d), 9))) and r["distance"] == pytest.approx(min(d), abs=1e-6)
    whole = plain_kmeans_of_first(x, 4)
    assert cluster.codebook(frames, 4) == pytest.approx(whole)


def plain_kmeans_of_first(x, k):
    c = x[:k].copy()
    for _ in range(20):
        code = np.array([np.argmin(np.round(((v - c) ** 2).sum(1), 9)) for v in x])
        c = np.stack([x[code == i].mean(0) if (code == i).any() else c[i] for i in range(k)])
    return c


def test_pools_and_banks_by_hand(frames):
    f = frames.withColumn("pattern", (F.col("utt") % 2).cast("int"))
    pool = cluster.quantized_pool(f, most=4, least=20).collect()
    sizes = {(r["pattern"], r["phone"], r["gender"]): r["n"] for r in f.groupBy("pattern", "phone", "gender").agg(F.count("*").alias("n")).collect()}
    kept = {k: n for k, n in sizes.items() if n >= 20}
    x = matrix(frames)
    for k, n in kept.items():
        own = [i for i in range(240) if ((i // 20) % 2, i // 60, "mf"[i % 2]) == k]
        got = sorted((r for r in pool if (r["pattern"], r["phone"], r["gender"]) == k), key=lambda r: r["center_no"])
        assert np.array([r["center"] for r in got]) == pytest.approx(plain_kmeans(x[own], min(4, n // 2)))
    facts = cluster.skipped_groups(f, 20).first()
    assert (facts["groups"], facts["skipped"]) == (len(sizes), len(sizes) - len(kept))
    protos = cluster.prototypes(frames, 10, DIMS).collect()
    per = {s: sum(r["speaker"] == s for r in protos) for s in range(7)}
    assert set(per.values()) == {10} and all(np.linalg.norm(r["center"]) == pytest.approx(1, abs=1e-6) for r in protos)
    alone = cluster.prototypes(frames, 5, DIMS, by_phone=False)
    assert alone.count() == 35
    some = cluster.bank(frames, DIMS, clusters=3, per_cluster=6, least_speakers=2)
    sub = cluster.sub_clustered(some, DIMS, 2).collect()
    rows = {(r["phone"], r["center_no"]) for r in some.filter("center_no is not null").collect()}
    assert {(r["phone"], r["center_no"]) for r in sub} == rows
    assert all(np.array(r["centroid"]) == pytest.approx(np.array(r["mean"])) for r in sub)
    coded = cluster.purified_bank(frames, lambda v: v[:, :2] * 3.0, 2, clusters=3, per_cluster=4)
    assert all(r["encoded"] == pytest.approx([3 * v for v in r["feature"][:2]]) for r in coded.collect())
    e = stats.confusion_entropy(frames, stats.speaker_centroids(frames, DIMS))
    confused = cluster.pseudo_bank(frames, e, DIMS, clusters=2, least_speakers=1)
    edges = {p: np.percentile([r["entropy"] for r in e.collect() if r["phone"] == p], 60) for p in range(1, 4)}
    high = {r["frame_id"] for r in e.collect() if r["phone"] and r["entropy"] >= edges[r["phone"]]}
    assert {r["frame_id"] for r in confused.collect()} <= high
    sweep = cluster.codebook_sweep(frames, (2, 4), steps=3, sample=100).collect()
    assert [r["k"] for r in sweep] == [2, 4] and all(0 <= r["entropy_bits"] <= 2 for r in sweep)


def test_cells_find_most_neighbours_and_all_cells_find_all(frames):
    exact = knn.nearest(frames, frames, [], 4, "l2", exclude_self=True)
    index = knn.cell_index(frames, 6)
    assert index[0].count() == 240
    assert sorted(knn.nearest_in_cells(frames, index, [], 4, 6, metric="l2", exclude_self=True).collect()) == sorted(exact.collect())
    some = knn.nearest_in_cells(frames, index, [], 4, 3, metric="l2", exclude_self=True)
    assert 0.9 <= knn.recall(some, exact).first()["recall"] <= 1
    styles = stats.centroids(frames, ["utt"], DIMS).select("utt", F.lit("x").alias("gender"), F.col("centroid").alias("feature"))
    assert knn.coarse_style_search(styles, styles, 3, 3).filter("query_id = pool_id").count() == 12


def test_retrievers_by_name(frames):
    assert knn.retriever("speaker_prototype", dims=DIMS, speaker=1)(frames, frames.filter("speaker < 3")).filter("not found").count() == 0
    with pytest.raises(ValueError):
        knn.retriever("nothing")
    assert knn.target_speaker(frames, "fixed", fixed=3) == 3 and knn.target_speaker(frames, "pool") is None
    f = frames.withColumn("gender", F.when(F.col("speaker") < 2, "m").otherwise("f"))
    assert knn.target_speaker(f, gender="m") in (0, 1) and knn.target_speaker(f, gender="x") in range(7)
    whole = knn.prototype_retriever(frames, frames, DIMS, k=1)
    assert matrix(whole.withColumnRenamed("query_id", "frame_id"), "vector") == pytest.approx(matrix(frames))
    centers = frames.filter("phone = 1").select("phone", "gender", F.col("frame_id").alias("center_id"), F.col("feature").alias("center"))
    mixed = {r["query_id"]: r["found"] for r in knn.prototype_retriever(frames, frames.filter("speaker = 9"), DIMS, speaker=9, centers=centers).collect()}
    assert mixed == {i: i // 60 == 1 for i in range(240)}


def test_windows_are_replaced_whole(frames):
    f = frames.join(stats.centroids(frames, ["utt"], DIMS).select("utt", F.col("centroid").alias("style")), "utt").withColumnRenamed("utt", "win")
    sources, windows = f.filter("win % 3 = 0 AND t < 7"), f.filter("win % 3 = 1 AND phone < 3")
    out = knn.window_retriever(sources, windows, [0, 1, 2, 3])
    assert out.groupBy("win").count().filter("count = 7").count() == 4
    best = {r["query_id"]: r["pool_id"] for r in knn.window_matches(sources, windows, "win", "win", [0, 1, 2, 3], weight=0.2).collect()}
    rows = {(r["win"], r["i"]): r["feature"] for r in out.collect()}
    x = matrix(frames)
    for w in (3, 6):  # phones 1 and 2 have a window of their own dominant phone
        mine = [r["win"] for r in windows.filter(f"phone = {w // 3}").select("win").distinct().collect()]
        assert best[w] in mine and rows[w, 0] == pytest.approx(list(x[20 * best[w]])) and rows[w, 6] == pytest.approx(list(x[20 * best[w] + 19]))
    assert [v for k, v in sorted(knn_rows(knn.window_retriever(sources, windows.limit(0), [0, 1, 2, 3])).items())] == [list(x[20 * w + t]) for w in (0, 3, 6, 9) for t in range(7)]


def knn_rows(df):
    return {(r["win"], r["i"]): list(r["feature"]) for r in df.collect()}


def test_silhouette_of_a_sample_and_probes(frames):
    assert -1 <= metrics.silhouette(frames, "phone", sample=50).first()[0] <= 1
    probes = metrics.four_way_probe(frames.withColumn("other", F.reverse("feature")), ["feature", "other"], ["phone"])
    assert set(probes) == {("feature", "phone"), ("other", "phone")} and min(probes.values()) > 0.8


def test_offline_steps_in_buckets_give_the_same(spark, frames, tmp_path):
    found = []
    for buckets in (0, 3):
        plan = Offline(spark, f"file://{tmp_path}/plan{buckets}", {"dims": DIMS, "speaker_directions": 2, "least_utterances": 1, "codes": 4, "steps": 3, "buckets": buckets})
        frames.write.parquet(plan.path("frames"))
        assert set(plan.run(["subspace", "cleaned", "codebook", "symbols"]).values()) == {"done"}
        found.append(sorted(tuple(r) for r in plan.table("symbols").select("frame_id", "utt", "t", "phone", "symbol").collect()))
    assert found[0] == found[1] and len(found[0]) == 240


def test_silhouette_meets_all_blocks_in_many_partitions(spark, frames):
    """Partitions of their own for all blocks, as large tables have them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few, many = (metrics.silhouette(frames, "phone", block_rows=n).first()[0] for n in (1000, 40))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x, phone = matrix(frames), np.repeat(np.arange(4), 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sums = np.stack([d[:, phone == c].sum(1) for c in range(4)], 1)
    own = sums[np.arange(240), phone] / 59
    other = np.where(np.arange(4) == phone[:, None], np.inf, sums / 60).min(1)
    want = np.mean((other - own) / np.maximum(own, other))
    assert few == pytest.approx(want, abs=1e-9) and many == pytest.approx(want, abs=1e-9)


def test_silhouettes_copy_no_rows_and_meet_files_in_parts(spark, frames):
    """Two clusterings at once, one of many clusters and rows of none; equal vectors have a silhouette of 0."""
    rows = frames.select("frame_id", "feature", "phone", F.when(F.col("frame_id") % 7 > 0, F.concat(F.lit("c"), F.col("frame_id") % 80)).alias("many"))
    found = metrics.silhouettes(rows, ["phone", "many"], block_rows=50)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    x, ids = matrix(frames), np.array([r[0] for r in rows.select("frame_id").orderBy("frame_id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for got, label, some in zip(found.first(), (np.repeat(np.arange(4), 60), ids % 80), (ids >= 0, ids % 7 > 0)):
        sub, own = d[np.ix_(some, some)], label[some]
        scores = []
        for i, c in enumerate(own):
            means = {k: sub[i, own == k].sum() / ((own == k).sum() - (k == c)) if (own == k).sum() > (k == c) else None for k in set(own)}
            b = min(v for k, v in means.items() if k != c)
            scores.append(0 if means[c] is None else (b - means[c]) / max(b, means[c]))
        assert got == pytest.approx(np.mean(scores), abs=1e-9)
    assert metrics.silhouette(rows.withColumn("feature", F.array(*[F.lit(0.1)] * DIMS)), "phone").first()[0] == 0


def test_codebook_sweep_copies_no_rows(frames):
    found = cluster.codebook_sweep(frames, (2, 4), steps=3)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    coded = frames
    for k, centers in cluster.codebooks(frames, (2, 4), "feature", "frame_id", 3).items():
        coded = cluster.encode(coded, centers, "feature", f"code{k}")
    assert [r["silhouette"] for r in found.orderBy("k").collect()] == pytest.approx([metrics.silhouette(coded, f"code{k}").first()[0] for k in (2, 4)])


def test_pseudo_retriever_searches_once(frames):
    found = knn.pseudo_retriever(frames, frames.filter("phone < 3"), DIMS)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 240 and found.filter("found").count() == 240
