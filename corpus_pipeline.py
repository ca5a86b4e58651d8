"""A corpus pipeline over ``documents``: language, near duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and
reread as the next one's ``docs``. All but the last return the columns of ``docs``, extra ones too, whatever their
names. Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table: a null text
counts as an empty one but stays null; a null doc_id or source is a value like any other, except that a row without an
id is no one's near duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import bpe, langid, mixing, ngram_join, pii
from stratapanel.llm.common import scratch_path, table
from stratapanel.llm.queries import tokenizer


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject (no letter, or unlike every language) go.

    Null and empty texts have no letter and go. The models are fitted on the labelled documents of the stage's own
    input; without any label all documents stay. Each text is scored in the row it is in, so nothing is joined back.
    """
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, of repeated rows one; null and empty texts all stay."""
    return ngram_join.kept_documents(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; n_chars follows the text. All rows stay, repeated ones too."""
    redacted = pii.redact(docs, pii.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that sources meet their target sizes; texts without words follow their source's whole rate."""
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.round_trip(docs, *tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: No SQL: language models, boosted trees and byte-pair merges have none; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
