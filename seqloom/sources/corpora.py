"""Corpus folders, speaker lists, Kaldi maps, JSON metadata and file lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import vec


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def mixdown(channels: Column) -> Column:
    """One channel out of an array of channels, each an array of samples: their mean, sample by sample; null without channels."""
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels), F.lit(1))), channels[0], lambda s, c: vec.plus(s, c))
    return F.when(F.size(channels) > 0, F.transform(total, lambda x: x / F.size(channels)))


def audio_files(spark: SparkSession, root: str, extensions=("flac", "wav")) -> DataFrame:
    """(path, speaker, chapter, utt_id) of root/speaker/chapter/file. The first extension with any file is taken; hidden copies are skipped. Contents
    aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root).select("path")
    parts = F.split("path", "/")
    rows = found.withColumns({"file": F.element_at(parts, -1), "chapter": F.element_at(parts, -2), "speaker": F.element_at(parts, -3)}).filter(~F.col("file").startswith("._"))
    rows = rows.withColumns({"utt_id": F.regexp_replace("file", "\\.[^.]*$", ""), "ext": F.regexp_extract("file", "\\.([^.]*)$", 1)})
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    first = rows.agg(F.min(rank).alias("first"))
    return rows.withColumn("rank", rank).join(F.broadcast(first), F.col("rank") == F.col("first")).drop("rank", "first", "ext", "file")


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, gender, subset) of a list parted by | with ; before comments, gender lower-cased."""
    lines = spark.read.text(path).filter(~F.col("value").startswith(";") & (F.trim("value") != ""))
    parts = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    return lines.select(parts[0].alias("speaker"), F.lower(parts[1]).alias("gender"), parts[2].alias("subset")).filter("gender is not null")


def speakers_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("gender", F.lower("gender"))


def speaker_list(spark: SparkSession, root: str, names=("SPEAKERS.TXT", "speakers.tsv")) -> DataFrame:
    """The first of the lists that root has: one parted by | or, by its ending, by tabs."""
    for name in names:
        if exists(spark, path := f"{root.rstrip('/')}/{name}"):
            return speakers_tsv(spark, path) if name.lower().endswith(".tsv") else speakers(spark, path)
    raise FileNotFoundError(f"none of {list(names)} in {root}")


def session_files(spark: SparkSession, root: str, sessions=None) -> DataFrame:
    """(path, utt_id, session, speaker, gender) of root/Session<n>/sentences/wav/dialog/file.wav, of the sessions asked for. Hidden copies are
    skipped; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root).select("path")
    rows = found.withColumns({"file": F.element_at(F.split("path", "/"), -1), "session": F.regexp_extract("path", "/Session(\\d+)/sentences/wav/[^/]+/[^/]+$", 1)})
    rows = rows.filter((F.col("session") != "") & ~F.col("file").startswith("._")).withColumn("utt_id", F.regexp_replace("file", "\\.wav$", ""))
    if sessions is not None:
        rows = rows.filter(F.col("session").isin([str(x) for x in sessions]))
    said = session_parts(F.col("utt_id"))
    return rows.select("path", "utt_id", F.col("session").cast("int").alias("session"), said["speaker"].alias("speaker"), F.coalesce(F.nullif(said["gender"], F.lit("")), F.lit("unknown")).alias("gender"))


def find_audio(utterances: DataFrame, files: DataFrame, roots: list[str], extensions=("flac", "wav")) -> DataFrame:
    """utterances (utt_id) with the path of their file, null where there is none: out of files (path), root/split/speaker/chapter/utt_id.ext or
    root/speaker/chapter/utt_id.ext.

    Ids are parted by - or else by _. Earlier roots go first, then earlier extensions, then folders below a split, then paths.
    """
    ids = utterances.select("utt_id").distinct()
    parts = F.when(F.size(F.split("utt_id", "-")) >= 3, F.split("utt_id", "-")).when(F.size(F.split("utt_id", "_")) >= 3, F.split("utt_id", "_"))
    wanted = ids.select("utt_id", parts[0].alias("speaker"), parts[1].alias("chapter"))
    at = F.split("path", "/")
    name = F.element_at(at, -1)
    placed = files.select("path", F.regexp_replace(name, "\\.[^.]*$", "").alias("utt_id"), F.regexp_extract(name, "\\.([^.]*)$", 1).alias("ext"), F.element_at(at, -2).alias("chapter"), F.element_at(at, -3).alias("speaker"))
    above = F.regexp_replace("path", "/[^/]*/[^/]*/[^/]*$", "")
    tops = [r.rstrip("/") for r in roots]
    below = [F.when(above.endswith(r), F.lit(2 * i + 1)).when(F.regexp_replace(above, "/[^/]*$", "").endswith(r), F.lit(2 * i)) for i, r in enumerate(tops)]
    rank = F.least(*below, F.lit(None).cast("int"))
    ext = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    placed = placed.withColumns({"__in": rank, "__ext": ext}).filter("__in is not null and __ext > 0")
    best = wanted.join(placed, ["utt_id", "speaker", "chapter"]).groupBy("utt_id").agg(F.min(F.struct(F.floor(F.col("__in") / 2).alias("root"), "__ext", "__in", "path"))["path"].alias("path"))
    return utterances.join(best, "utt_id", "left")


def gender_of(value: Column) -> Column:
    """m, f or null from any of the spellings in use."""
    said = F.lower(F.trim(value.cast("string")))
    return F.when(said.isin("m", "male", "0"), "m").when(said.isin("f", "female", "1"), "f")


def session_parts(utt: Column) -> dict[str, Column]:
    """Speaker, gender and session of ids like Ses01F_impro01_F000: the letter of the last part tells who speaks."""
    session, who = F.regexp_extract(utt, "Ses(\\d+)", 1), F.regexp_extract(utt, "_([FM])\\d+$", 1)
    return {"session": session, "gender": F.lower(who), "speaker": F.concat(F.lit("Ses"), session, who)}


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): lines split once at white space; empty lines are left out."""
    parts = F.split(F.trim("value"), "\\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("id"), parts[1].alias("value"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(parts[0].alias("id"), parts[1].alias("value"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).filter(F.size(parts) == 3).select(parts[0].alias("enroll"), parts[1].alias("test"), parts[2].alias("label"))


def spk2utt(utterances: DataFrame, speaker: str = "speaker", utt: str = "utt") -> DataFrame:
    """(speaker, utts): each speaker's utterances, sorted, parted by spaces: one line of text a speaker."""
    return utterances.groupBy(speaker).agg(F.array_join(F.sort_array(F.collect_list(F.col(utt).cast("string"))), " ").alias("utts"))


def write_lines(df: DataFrame, columns: list[str], path: str) -> None:
    """A text line per row, columns parted by spaces."""
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The utterances of a JSON file with header fields and a list `utterances`."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("utterances").alias("u")).select("u.*")


def write_metadata(spark: SparkSession, utterances: DataFrame, path: str, **header) -> None:
    """utterances as JSON lines in path/utterances and the header's fields in path/header, which `read_metadata` gives back."""
    utterances.write.json(f"{path.rstrip('/')}/utterances")
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/header")


def read_metadata(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, dict]:
    """The utterances and the header that write_metadata wrote."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    header = spark.read.text(f"{path.rstrip('/')}/header").first()
    return reader.json(f"{path.rstrip('/')}/utterances"), json.loads(header[0]) if header else {}


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(pool_id, gender, speaker) of a JSON file of pools."""
    pools = spark.read.option("multiLine", True).json(path).select(F.explode("pools").alias("p")).select("p.*")
    parts = [pools.select("pool_id", F.lit(g).alias("gender"), F.explode(c).alias("speaker")) for g, c in (("m", "male"), ("f", "female"))]
    return parts[0].unionByName(parts[1])


def with_original(outputs: DataFrame, originals: DataFrame, extensions=("flac", "wav")) -> DataFrame:
    """outputs (utt_id, ...) with the path of the original: the first extension that exists; those without are left out."""
    out, paths = outputs, []
    for e in extensions:
        some = originals.filter(F.col("path").endswith("." + e)).groupBy("utt_id").agg(F.min("path").alias(f"path_{e}"))
        out, paths = out.join(some, "utt_id", "left"), [*paths, f"path_{e}"]
    return out.withColumn("original", F.coalesce(*paths)).drop(*paths).filter("original is not null")
