"""A corpus pipeline: language ID, near-duplicate removal, PII redaction, packing. Counted as part of paperloom.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import jaccard, langid, packing, pii
from paperloom.llm.queries import vocabulary
from paperloom.llm.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; null, empty and letterless texts and those that fit no language go; repeated rows go or stay together."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by Jaccard >= 0.8 on five-word shingles; rows with a null doc_id stay."""
    return jaccard.keep_first(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with identifiers replaced by their kind, and n_chars counted again; null texts and all rows stay."""
    return pii.scrub(docs).withColumns(pii.recounted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences; null and empty texts are one end mark, repeated rows packed each."""
    return packing.pack(docs, vocabulary(), end=2, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Tokens, model fits and disguises have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again by the next.

    An empty table gives no rows; columns of any name and type pass the stages before the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
