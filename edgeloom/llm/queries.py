"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import chat, media, neardup, neighbours, packing, pieces, quality, repeats, secrets, sharding
from edgeloom.llm.common import table
from edgeloom.llm.oracle import ORACLE_SQL  # noqa: F401  for __spark_entry__.py


def op2_media_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_minhash_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_suffix_blockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept", "whole")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rp_forest, op2_media_signature, op5_secret_scan, op8_quality_fm, op9_chat_template, op6_best_fit_packing, op3_minhash_circulant, op10_hilbert_shards, op4_suffix_blockwise, op7_sentencepiece_lattice)}
