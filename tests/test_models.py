"""Models that are learnt in batches or from merged factors, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import predict
from seqloom.operators import cluster, linalg, minibatch, sketches

DIMS = 12


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    return rng.normal(size=(700, DIMS)) * np.linspace(6, 0.2, DIMS) @ np.linalg.qr(rng.normal(size=(DIMS, DIMS)))[0] + 5


@pytest.fixture(scope="module")
def frames(spark, vectors):
    rows = [(i, i % 90, None if i == 699 else [float(v) for v in x]) for i, x in enumerate(vectors)]
    return spark.createDataFrame(rows, "frame_id bigint, speaker int, feature array<double>").repartition(21, "frame_id").cache()


def up_to_sign(a, b):
    return np.minimum(np.abs(a - b).max(1), np.abs(a + b).max(1)).max()


@pytest.mark.parametrize("rows", [None, 9])
def test_merged_factors(spark, frames, vectors, rows):
    x = vectors[:-1]
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    found = sketches.leading(frames, 3, rows=rows, batch=25)
    assert found["n"] == 699 and found["mean"] == pytest.approx(x.mean(0))
    assert found["variance"] == pytest.approx(s[:3] ** 2 / 698, rel=1e-9 if rows is None else 1e-3)
    assert up_to_sign(found["components"], vt[:3]) < (1e-9 if rows is None else 2e-2)
    if rows is None:
        plain = linalg.pca(frames, DIMS, 3)
        assert found["components"] == pytest.approx(plain["components"], abs=1e-8) and found["ratio"] == pytest.approx(plain["ratio"])


def test_order_changes_truncated_factors_little(vectors):
    rng = np.random.default_rng(0)
    found = []
    for _ in range(6):
        now = None
        for part in np.array_split(vectors[rng.permutation(len(vectors))], 30):
            new = sketches.of_batch(part, 6)
            now = new if now is None else sketches.merged([now, new], 6)
        _, s, vt = np.linalg.svd(now[2], full_matrices=False)
        found.append((s[:3], vt[:3]))
    assert max(np.abs(s / found[0][0] - 1).max() for s, _ in found) < 0.01
    assert max(up_to_sign(v, found[0][1]) for _, v in found) < 0.1
    assert sketches.merged([(0, np.zeros(2), np.zeros((0, 2))), sketches.of_batch(np.eye(2)), (0, np.zeros(2), np.zeros((0, 2)))])[0] == 2


def test_wide_vectors_need_no_square_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 4096))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame_id bigint, feature array<double>").repartition(5)
    found = sketches.incremental_pca(df, 3, spare=2, batch=10)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert found["components"].shape == (3, 4096) and found["variance"] == pytest.approx(s[:3] ** 2 / 59)
    assert up_to_sign(found["components"], vt[:3]) < 1e-9
    assert sketches.incremental_pca(df.limit(0), 3)["components"].shape == (0, 0)


def test_subspace_of_many_speakers(frames, vectors):
    means = np.stack([vectors[:699][np.arange(699) % 90 == s].mean(0) for s in range(90)])
    _, s, vt = np.linalg.svd(means - means.mean(0), full_matrices=False)
    found = linalg.subspace(frames, "speaker", DIMS, 5)
    assert up_to_sign(found["basis"], vt[:5]) < 1e-8 and found["ratio"] == pytest.approx(s[:5] ** 2 / (s**2).sum())
    assert linalg.subspace(frames, "speaker", DIMS, 5, least=100)["basis"].shape == (0, DIMS)


def plain_minibatch(x, batches, k):
    centers, rows = x[:k].copy(), np.zeros(k)
    for b in batches:
        code = ((x[b][:, None] - centers[None]) ** 2).sum(2).round(9).argmin(1)
        for c in np.unique(code):
            own = x[b][code == c]
            rows[c] += len(own)
            centers[c] += len(own) / rows[c] * (own.mean(0) - centers[c])
    return centers, rows


def test_minibatch_codebook(spark, frames, vectors, tmp_path):
    parts = [np.arange(a, min(a + 90, z)) for a, z in ((0, 250), (400, 650)) for a in range(a, z, 90)]
    batches = minibatch.segments(frames, [(0, 250), (400, 250)], 90)
    want, rows = plain_minibatch(vectors, parts, 5)
    path = f"file://{tmp_path}/codebook"
    state = minibatch.fitted(batches[:3], 5, path)
    assert minibatch.load(spark, path).batch == 2
    # goes on behind the third: the first three are not read again
    state = minibatch.fitted([b.filter(F.raise_error(F.lit("read again")).isNull()) if i < 3 else b for i, b in enumerate(batches)], 5, path)
    assert state.centers == pytest.approx(want) and state.rows.tolist() == rows.tolist() and state.batch == 5
    assert minibatch.partial_fit(state, batches[0], 5) is state
    assert minibatch.even_segments(1000, 100, 4) == [(0, 25), (325, 25), (650, 25), (975, 25)] and minibatch.even_segments(10, None, 4) == [(0, 10)]
    assert minibatch.load(spark, f"{path}-none") is None


def test_small_batches_are_learnt_in_runs(spark, frames, vectors, tmp_path, monkeypatch):
    """The same state as batch by batch, a save a run; a run that stopped goes on behind the last one."""
    rows = frames.filter("frame_id < 290")
    want = minibatch.fitted(minibatch.segments(rows, [(0, 290)], 20), 5, f"file://{tmp_path}/single")
    saved, save = [], minibatch.save
    monkeypatch.setattr(minibatch, "save", lambda spark, state, path: (saved.append(state.batch), save(spark, state, path)))
    path = f"file://{tmp_path}/runs"
    minibatch.fitted_in_runs(rows, 100, 20, 5, path, run_rows=100)
    state = minibatch.fitted_in_runs(rows.filter("frame_id >= 100"), 290, 20, 5, path, run_rows=100)
    assert saved == [4, 9, 14] and state.batch == want.batch == 14
    assert np.allclose(state.centers, want.centers) and (state.rows == want.rows).all()
    single = minibatch.fitted_in_runs(rows, 290, 100, 5, f"file://{tmp_path}/large", run_rows=100)
    assert np.allclose(single.centers, minibatch.fitted(minibatch.segments(rows, [(0, 290)], 100), 5, f"file://{tmp_path}/segments").centers)


def test_minibatch_codebook_of_a_stream(spark, frames, vectors, tmp_path):
    for i in range(3):
        frames.filter((F.col("frame_id") >= 100 * i) & (F.col("frame_id") < 100 * i + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
        minibatch.streamed(stream, 4, f"file://{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    want, rows = plain_minibatch(vectors, [np.arange(100 * i, 100 * i + 100) for i in range(3)], 4)
    state = minibatch.load(spark, f"file://{tmp_path}/state")
    assert state.centers == pytest.approx(want) and state.rows.tolist() == rows.tolist() and state.batch == 2


def test_fewer_rows_than_centers(spark, frames, tmp_path):
    state = minibatch.fitted([frames.filter("frame_id < 3"), frames.limit(0)], 9, f"file://{tmp_path}/few")
    assert state.centers.shape == (3, DIMS) and state.rows.tolist() == [1, 1, 1] and state.batch == 1
    assert cluster.encode(frames.filter("frame_id < 3"), state.centers).count() == 3


def test_codebooks_of_several_sizes_in_shared_passes(frames, monkeypatch):
    some = frames.filter("feature is not null")
    want = {k: cluster.codebook(some, k, steps=6) for k in (2, 5, 9)}
    passes, summed = [], cluster._summed
    monkeypatch.setattr(cluster, "_summed", lambda *a: passes.append(1) or summed(*a))
    got = cluster.codebooks(some, (2, 5, 9), steps=6)
    assert all(got[k] == pytest.approx(want[k]) for k in want) and len(passes) <= 6


def test_models_are_loaded_once_a_worker(spark, frames, vectors, tmp_path):
    weights = np.random.default_rng(9).normal(size=(DIMS, 3))
    loads = tmp_path / "loads"
    loads.mkdir()

    def load():
        import os
        import uuid

        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda x: {"low": np.tanh(x), "high": x @ weights, "best": (x @ weights).argmax(1)}

    out = predict.with_layers(frames, load, {"low": "array<double>", "high": "array<double>", "best": "bigint"}, batch_bytes=8 * DIMS * 10)
    rows = out.orderBy("frame_id").collect()
    for r in rows[:-1]:
        x = vectors[r["frame_id"]]
        assert r["layers"]["low"] == pytest.approx(np.tanh(x)) and r["layers"]["high"] == pytest.approx(x @ weights) and r["layers"]["best"] == (x @ weights).argmax()
    assert rows[-1]["layers"] is None
    names = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(names) == len(set(names)) < 21, "a worker has loaded it twice"


def test_stored_models_are_told_apart(spark, frames, vectors, tmp_path):
    rng = np.random.default_rng(1)
    w = {"w0": rng.normal(size=(DIMS, 7)), "b0": rng.normal(size=7), "w1": rng.normal(size=(7, 4)), "b1": rng.normal(size=4)}
    np.savez(tmp_path / "mlp.npz", **w)
    np.savez(tmp_path / "lin.npz", mean=vectors[:-1].mean(0), components=np.eye(DIMS)[:3])
    np.savez(tmp_path / "odd.npz", gamma=np.ones(3))
    want = {i: int((np.maximum(x @ w["w0"] + w["b0"], 0) @ w["w1"] + w["b1"]).argmax()) for i, x in enumerate(vectors)} | {699: None}
    assert {r["frame_id"]: r["label"] for r in predict.predicted(frames, str(tmp_path / "mlp.npz")).collect()} == want
    want = {i: int((x - vectors[:-1].mean(0))[:3].argmax()) for i, x in enumerate(vectors)} | {699: None}
    assert {r["frame_id"]: r["label"] for r in predict.predicted(frames, str(tmp_path / "lin.npz")).collect()} == want
    with pytest.raises(ValueError, match="gamma"):
        predict.load_model(str(tmp_path / "odd.npz"))
    with pytest.raises(ValueError, match="there already"):
        predict.predicted(frames, str(tmp_path / "mlp.npz"), out="speaker")
