"""From raw documents to packed training sequences: drop low quality, keep one of each group of near copies, drop documents
that hold benchmark items, replace personal data, pack. Each stage reads what the one before wrote."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from highwater.llm.common import Scratch
from highwater.llm.decontaminate import without_items
from highwater.llm.ngram_join import one_of_each
from highwater.llm.packing import pack
from highwater.llm.pii import redact
from highwater.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

# training, components and token ids cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written as Parquet and read again."""
    s, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
