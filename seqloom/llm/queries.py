"""Queries that apply the training-data operators to whole tables, and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    collision_search,
    conversation_repair,
    exact_dedup,
    jaccard_join,
    mixing,
    piece_sampling,
    quality_model,
    quality_rules,
    secrets,
    sharding,
    token_alignment,
    url_filter,
    warc,
)
from seqloom.llm.common import new_path, stored, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the labels are what the listed rules block; the table `labels` is of documents and says nothing about urls
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors, net = quality_model.train(docs, labels.filter(~quality_model.held_out(F.col("doc_id"))))
    out = quality_model.score(docs, vectors, net)
    return out.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.write(table(spark, sf_dir, "pages"), path := new_path(spark, "warc"))
    return warc.digests(warc.read(spark, path))


#: A model file that every executor has.
PIECE_MODEL = os.environ.get("SEQLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled(table(spark, sf_dir, "documents"), PIECE_MODEL, k=2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


#: The shares of tokens that the mixture aims at, by domain of the labelled table. Poor texts get so little that what the
#: pipeline's filters leave of them isn't repeated.
WEIGHTS = {"good": 0.95, "good toxic": 0.045, "poor": 0.004, "poor toxic": 0.001}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    domain = F.concat(F.when(F.col("quality") > 0, "good").otherwise("poor"), F.when(F.col("toxic") > 0, " toxic").otherwise(""))
    return table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null").select("doc_id", domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), WEIGHTS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sharding.document_rows(table(spark, sf_dir, "documents")), "shard-rows")
    out = sharding.hilbert_shards(rows, ["size", "source", "lang", "doc_id"], ["doc_id", "text_crc32", "size"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.NUMBERS, "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, vector="embedding")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversation_repair.damaged(turns), turns)


#: A tokenizer file that every executor has.
BYTE_BPE = os.environ.get("SEQLOOM_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.with_counts(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL)


OPERATORS = (
    op1_url_filters,
    op2_quality_classifier,
    op3_warc,
    op4_sentencepiece,
    op5_exact_dedup,
    op6_mixing,
    op7_sharding,
    op8_quality_rules,
    op9_jaccard_join,
    op10_secret_scans,
    op11_nearest_neighbours,
    op12_conversation_repair,
    op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from seqloom.llm import oracles

    return oracles.sql()
