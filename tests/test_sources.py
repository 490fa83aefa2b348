"""Sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from seqloom.plans.config import load, merged
from seqloom.sources import corpora, frames
from seqloom.streaming.labels import closed_runs, window_counts


def test_kaldi_maps(spark, tmp_path):
    (tmp_path / "wav.scp").write_text("a x/y z.wav\n\nb w.wav\n")
    (tmp_path / "trials").write_text("a b target\nbad line\n")
    assert corpora.read_scp(spark, str(tmp_path / "wav.scp")).orderBy("id").collect() == [("a", "x/y z.wav"), ("b", "w.wav")]
    assert corpora.read_trials(spark, str(tmp_path / "trials")).collect() == [("a", "b", "target")]
    corpora.write_lines(corpora.spk2utt(spark.createDataFrame([("s", "u2"), ("s", "u1")], "speaker string, utt string")), ["speaker", "utts"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect() == [("s u1 u2",)]


def test_corpus_folder_and_speakers(spark, tmp_path):
    for name in ("1/2/1-2-3.wav", "1/2/1-2-4.flac", "1/2/._1-2-5.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["utt_id"] for r in corpora.audio_files(spark, str(tmp_path)).collect()] == ["1-2-4"]
    (tmp_path / "SPEAKERS").write_text("; id | sex\n14 | F | train | x\n")
    assert corpora.speakers(spark, str(tmp_path / "SPEAKERS")).collect() == [("14", "f", "train")]
    parts = corpora.session_parts(F.lit("Ses01F_impro01_M003"))
    assert spark.range(1).select(parts["speaker"], parts["gender"]).first() == ("Ses01M", "m")


def test_originals_fall_back(spark):
    out = spark.createDataFrame([("a",), ("b",), ("c",)], "utt_id string")
    have = spark.createDataFrame([("a", "a.flac"), ("a", "a.wav"), ("b", "b.wav")], "utt_id string, path string")
    assert [(r["utt_id"], r["original"]) for r in corpora.with_original(out, have).orderBy("utt_id").collect()] == [("a", "a.flac"), ("b", "b.wav")]


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), float("nan") if i == 3 else 0.0]) for i in range(10)], "frame_id bigint, feature array<double>")
    frames.write(df, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert frames.read_range(back, 2, 5).count() == 3 and frames.read_indices(back, back.filter("frame_id > 7")).count() == 2
    assert frames.verified(back).first()["n_nan"] == 1
    assert frames.concatenated([back, back]).agg(F.max("frame_id")).first()[0] == 19
    pad = spark.createDataFrame([([1, 2, 3], 2), ([1], 3), ([], 1)], "l array<int>, n int").select(frames.aligned("l", "n")).collect()
    assert [r[0] for r in pad] == [[1, 2], [1, 0, 0], [0]]
    assert [r["severity"] for r in frames.pool_problems(back).collect()] == ["error", "warning"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": 2}}')
    assert load(str(tmp_path / "c.json"), a={"b": 5}) == {"a": {"b": 5, "c": 2}}
    assert merged({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "x"), (1, "2024-01-01 00:01:00", "x"), (1, "2024-01-01 00:02:00", "y"), (2, "2024-01-01 00:00:30", "x")]
    df = spark.createDataFrame(rows, "user_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("runs", closed_runs(stream)), ("counts", window_counts(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert [(r["key"], r["label"], r["n"]) for r in spark.sql("SELECT * FROM runs").collect()] == [("1", "x", 2)]


def test_speaker_lists_and_sessions(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpora.speaker_list(spark, str(tmp_path))
    (tmp_path / "speakers.tsv").write_text("speaker\tgender\n7\tM\n")
    assert [(r["speaker"], r["gender"]) for r in corpora.speaker_list(spark, str(tmp_path)).collect()] == [("7", "m")]
    (tmp_path / "SPEAKERS.TXT").write_text("; comment\n14 | F | train | 25 | x\n")
    assert [(r["speaker"], r["gender"]) for r in corpora.speaker_list(spark, str(tmp_path)).collect()] == [("14", "f")]
    for name in ("Session1/sentences/wav/d1/Ses01F_impro01_F000.wav", "Session2/sentences/wav/d1/Ses02F_x_M001.wav", "Session1/sentences/wav/d1/._Ses01F_impro01_F000.wav", "Session1/other/d1/a.wav"):
        (tmp_path / "em" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "em" / name).write_bytes(b"x")
    found = corpora.session_files(spark, str(tmp_path / "em")).orderBy("utt_id").collect()
    assert [(r["utt_id"], r["session"], r["speaker"], r["gender"]) for r in found] == [("Ses01F_impro01_F000", 1, "Ses01F", "f"), ("Ses02F_x_M001", 2, "Ses02M", "m")]
    assert corpora.session_files(spark, str(tmp_path / "em"), [2]).count() == 1


def test_find_audio(spark):
    files = spark.createDataFrame([("file:/r1/dev/100/121/100-121-1.wav",), ("file:/r1/dev/100/121/100-121-1.flac",), ("file:/r2/7/8/7_8_9.wav",), ("file:/r2/train/7/8/7_8_9.wav",), ("file:/r1/dev/100/999/100-121-2.flac",)], "path string")
    utts = spark.createDataFrame([("100-121-1",), ("7_8_9",), ("100-121-2",), ("plain",)], "utt_id string")
    got = {r["utt_id"]: r["path"] for r in corpora.find_audio(utts, files, ["/r1", "/r2"]).collect()}
    assert got == {"100-121-1": "file:/r1/dev/100/121/100-121-1.flac", "7_8_9": "file:/r2/train/7/8/7_8_9.wav", "100-121-2": None, "plain": None}


def test_appends_batches_and_attributes(spark, tmp_path):
    path = str(tmp_path / "frames")
    df = spark.range(5).select((F.col("id") * 10).alias("x"))
    assert frames.append(df, path, ["x"], {"dims": 2, "layer": 6}) == (0, 5)
    assert frames.append(df, path, ["x"], {"layer": 12}) == (5, 10)
    assert [[r["x"] for r in b] for b in frames.iterate(spark.read.parquet(path), 4)] == [[0, 10, 20, 30], [40, 0, 10, 20], [30, 40]]
    assert frames.attributes_of(spark, path)["dims"] == 2 and frames.attributes_of(spark, str(tmp_path / "none")) == {}


def test_metadata_round_trip(spark, tmp_path):
    utts = spark.createDataFrame([("a", 3), ("b", 4)], "utt_id string, num_frames int")
    corpora.write_metadata(spark, utts, str(tmp_path / "m"), total_frames=7, layer=6)
    back, header = corpora.read_metadata(spark, str(tmp_path / "m"), utts.schema)
    assert sorted(back.collect()) == sorted(utts.collect()) and header == {"total_frames": 7, "layer": 6}
    (tmp_path / "map").write_text("a x y\nb\nc z\n")
    assert sorted(tuple(r) for r in corpora.read_map(spark, str(tmp_path / "map")).collect()) == [("a", "x"), ("c", "z")]


def test_pools_are_checked_and_read_back(spark, tmp_path):
    pool = spark.createDataFrame([(i, [float(i)], i % 3, i % 2, i % 4) for i in range(10)], "frame_id bigint, feature array<double>, phone int, gender int, symbol int")
    assert "missing centers" in frames.save_pool(pool, str(tmp_path / "p"), settings={"dims": 1})
    back = frames.load_pool(spark, str(tmp_path / "p"))
    assert sorted(back.frames.select(*pool.columns).collect()) == sorted(pool.collect()) and back.centers is None and back.settings == {"dims": 1}
    pool.limit(9).select("frame_id", "phone").write.mode("overwrite").parquet(str(tmp_path / "p/phones"))
    assert "unequal lengths" in frames.pool_errors(spark, str(tmp_path / "p"))[0][0]
    pool.withColumn("frame_id", F.col("frame_id") + 1).select("frame_id", "phone").write.mode("overwrite").parquet(str(tmp_path / "p/phones"))
    assert frames.pool_errors(spark, str(tmp_path / "p"))[0] == ["phones of other frames"]
    with pytest.raises(ValueError, match="missing symbols"):
        frames.save_pool(pool.drop("symbol"), str(tmp_path / "q"))
    with pytest.raises(FileNotFoundError):
        frames.load_pool(spark, str(tmp_path / "none"))


def test_mixdown(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([[5.0]],), ([],)], "c array<array<double>>")
    assert [r[0] for r in df.select(corpora.mixdown(F.col("c"))).collect()] == [[2.0, 4.0], [5.0], None]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from seqloom.storage import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://there:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_scratch_deletes_its_tables(spark):
    from seqloom.storage import scratch, stored

    with scratch(spark):
        gone, kept = stored(spark.range(3), "gone"), stored(spark.range(4), "kept", outlives=True)
        with scratch(spark):
            inner = stored(gone, "inner", outlives=True)
        assert inner.count() == 3
    assert kept.count() == 4 and not any(corpora.exists(spark, d.inputFiles()[0]) for d in (gone, inner))
