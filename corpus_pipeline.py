"""The corpus pipeline: language ID, toxicity, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, which
are written as Parquet and read again in between.  All stages but the last return the
columns of ``documents``, whatever they are called; other columns of any name stay as they are.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables have a
defined result in every stage, as its docstring says; texts are always read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from celestile.llm import langid, minhash, mixing, packing, toxicity
from celestile.llm.common import save, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and undecided ones go.

    Repeated rows share their fate; without any labelled text all documents go.
    """
    return langid.keep_identified(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression doesn't find toxic; it learns from ``labels``.

    Null and blank texts stay; repeated rows share their fate; without labels all stay.
    """
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id.

    Of rows of one id and text one stays; rows without a word or an id all stay.
    """
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most.

    Null sources are one source; repeated rows are documents of their own; ties in size go by the
    md5 of the id, so reruns agree.
    """
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequences they lie in.

    A null text is its end id alone; a document that the mix takes several times is packed as often.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", civil), ("near-dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: Language ID, regression and packing have no SQL; tests hold each stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
