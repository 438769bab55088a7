"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caremeter.llm import language_id as L
from caremeter.llm.common import new_dir
from caremeter.llm.exact_dedup import drop_copies
from caremeter.llm.mixing import in_mix_order, mix
from caremeter.llm.order_minhash import drop_near_duplicates
from caremeter.llm.packing import in_file_order, pack
from caremeter.llm.queries import held_out, tokenizer


def columns_of(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are NULL, without letters or refused go."""
    model = L.fit(docs, where=~held_out())
    found = L.languages(docs.sparkSession, model)(F.col("text"))
    return docs.where(~found["rejected"])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, for each text."""
    return drop_copies(docs, keep="max")


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, for each class of near-duplicates."""
    return drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; those of small sources come again in later epochs."""
    return in_mix_order(mix(docs)).select(*columns_of(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of token ids each; ``sequence_id`` follows the order of the files, which is the mix."""
    return pack(docs, tokenizer("word_bpe_49k.json"), order=in_file_order(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_content),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Language ID, alignment and tokens are beyond SQL: tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
