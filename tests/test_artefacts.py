"""Readers of NumPy artefacts, and steps that go on where they stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import knn
from seqloom.plans import resume
from seqloom.sources import bucketed, npy


@pytest.fixture
def pool(tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 5)).astype(np.float32)
    parts = {"features": x, "symbols": np.arange(1000) % 7, "genders": np.arange(1000, dtype=np.int8) % 2, "phones": np.arange(1000, dtype=np.uint16) % 41}
    for n, v in parts.items():
        np.save(tmp_path / f"{n}.npy", v)
    return tmp_path, parts


def test_ranges_of_a_pool(spark, pool):
    path, parts = pool
    df = npy.read_pool(spark, f"file://{path}", rows=128)
    assert df.rdd.getNumPartitions() == 8 and df.dtypes[1:] == [("feature", "array<float>"), ("symbol", "bigint"), ("gender", "bigint"), ("phone", "bigint")]
    rows = df.orderBy("frame_id").collect()
    assert [r["frame_id"] for r in rows] == list(range(1000)) and (np.array([r["feature"] for r in rows], np.float32) == parts["features"]).all()
    assert all([r[c] for r in rows] == parts[n].tolist() for n, c in (("symbols", "symbol"), ("genders", "gender"), ("phones", "phone")))


def test_required_and_optional_parts(spark, pool):
    path, parts = pool
    (path / "phones.npy").unlink()
    assert npy.read_pool(spark, str(path)).columns == ["frame_id", "feature", "symbol", "gender"]
    (path / "genders.npy").rename(path / "other.npy")
    with pytest.raises(FileNotFoundError, match="genders"):
        npy.layout(str(path))
    np.save(path / "genders.npy", parts["genders"][:9])
    with pytest.raises(ValueError, match="unequal"):
        npy.layout(str(path))
    (path / "features.npy").rename(path / "features.h5")
    with pytest.raises(ValueError, match="HDF5"):
        npy.layout(str(path))
    np.save(path / "odd.npy", np.array([{}, 1], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError, match="unpickled"):
        npy.member(str(path / "odd.npy"))
    (path / "text.npy").write_text("no array at all")
    with pytest.raises(ValueError, match="not a"):
        npy.member(str(path / "text.npy"))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_of_an_npz(spark, tmp_path, save):
    wide = np.arange(60.0).reshape(20, 3)
    save(tmp_path / "many.npz", **{"3": wide, "11": wide[:2], "x": np.array(["a", "bc"]), "f": np.asfortranarray(wide), "none": wide[:0]})
    read = lambda m: [r["value"] for r in npy.registered(spark).read.format("npy").option("member", m).option("rows", 7).load(str(tmp_path / "many.npz")).orderBy("row").collect()]
    assert read("3") == wide.tolist() == read("f") and read("x") == ["a", "bc"] and read("none") == []
    assert npy.member(str(tmp_path / "many.npz"), "3").whole == (save is np.savez_compressed)


def test_clusters_and_pools_written_by_tasks(spark, tmp_path, pool):
    path, _ = pool
    np.savez(tmp_path / "phone_clusters.npz", **{"2": np.eye(3), "10": np.ones((1, 3))})
    assert [(r["phone"], r["center_no"], r["center"]) for r in npy.clusters(spark, str(tmp_path / "phone_clusters.npz")).orderBy("phone", "center_no").collect()] == [(2, 0, [1, 0, 0]), (2, 1, [0, 1, 0]), (2, 2, [0, 0, 1]), (10, 0, [1, 1, 1])]
    df = npy.read_pool(spark, str(path))
    written = npy.write_pool(df.repartitionByRange(3, "frame_id"), f"file://{tmp_path}/pools")
    assert written.agg(F.sum("rows")).first()[0] == 1000
    again = npy.read_pool(spark, f"file://{tmp_path}/pools")
    assert sorted(again.collect()) == sorted(df.collect())


def test_a_broken_step_goes_on(spark, tmp_path):
    df, path, seen = spark.range(500).withColumn("key", F.col("id") % 60), f"file://{tmp_path}/step", tmp_path / "seen"
    seen.mkdir()

    def work(broken):
        def each(batches):
            for b in batches:
                for k in set(b.column("key").to_pylist()):
                    if k == broken:
                        raise ValueError("stopped")
                    with open(seen / f"{k}", "a") as f:
                        f.write("x")
                yield b

        return lambda rows: rows.repartition(1).mapInArrow(each, rows.schema)

    with pytest.raises(Exception, match="stopped"):
        resume.in_buckets(df, work(17), path, "key", buckets=12, at_once=2)
    first = resume.done(spark, path)
    assert 0 < len(first) < 12 and len(first) % 2 == 0
    before = {p.name: len(p.read_text()) for p in seen.iterdir()}
    of = {r["key"]: r["b"] for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(12)).alias("b")).distinct().collect()}
    out = resume.in_buckets(df, work(None), path, "key", buckets=12, at_once=2)
    assert sorted(r["id"] for r in out.collect()) == list(range(500)) and resume.done(spark, path) == list(range(12))
    after = {p.name: len(p.read_text()) for p in seen.iterdir()}
    assert all(after[str(k)] == before[str(k)] for k, b in of.items() if b in first), "what was done is computed again"
    assert resume.in_buckets(df, work(3), path, "key", buckets=12).count() == 500


def test_a_bucketed_pool_stays_where_it_is(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i % 4, [float(v) for v in rng.normal(size=3)]) for i in range(400)]
    frames = spark.createDataFrame(rows, "frame_id bigint, phone int, feature array<double>")
    pool = bucketed.save(frames, "bucketed_pool", ["frame_id"], 6, f"{tmp_path}/pool")
    plain = frames.repartition(3).checkpoint() if spark.sparkContext.getCheckpointDir() else frames.repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = knn.nearest(frames.filter("frame_id < 50"), plain, ["phone"], 3)
        kept, moved = knn.mean_of(found, pool, 3), knn.mean_of(found, plain, 3)
        assert bucketed.exchanges(kept, "bucketed_pool") == 0
        a, b = ({r["query_id"]: r["vector"] for r in d.collect()} for d in (kept, moved))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
        unbucketed = spark.read.parquet(f"{tmp_path}/pool")
        assert bucketed.exchanges(knn.mean_of(found, unbucketed, 3), "FileScan parquet [frame_id") > 0
        assert sorted(bucketed.load(spark, "bucketed_pool").collect()) == sorted(frames.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_pool")


def test_pools_of_arrays_load_as_others(spark, pool, tmp_path):
    from seqloom.sources import frames

    path, _ = pool
    np.savez(path / "phone_clusters.npz", **{"4": np.eye(5)})
    found = frames.load_pool(spark, f"file://{path}")
    assert found.frames.count() == 1000 and found.centers.count() == 5
    segments = spark.createDataFrame([(0, 10, 15), (1, 12, 13), (2, 990, 1000), (3, 5, 5)], "segment bigint, start bigint, end bigint")
    rows = frames.gathered(found.frames, segments).select("segment", "frame_id").collect()
    assert sorted(tuple(r) for r in rows) == [(0, i) for i in range(10, 15)] + [(1, 12)] + [(2, i) for i in range(990, 1000)]
