"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, langid, lattice, minhash, mixing, packing, pivots, sharding, token_output, toxicity
from .common import table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_digest(token_output.write_ids(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_digest(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_near_vectors, op3_token_ids, op4_toxicity, op5_near_duplicates, op6_language, op7_top_k, op8_mix_sources, op9_shard, op10_class_lm)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": lattice.SQL, "op7_top_k": pivots.SQL, "op8_mix_sources": mixing.SQL, "op9_shard": sharding.SQL}
