"""The registered queries of the training-data operators, by the contracts of their result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import bpe, fill_middle, fingerprint, hamming_index, langid, mixing, ngram_join, oracles, pii, secrets, spelling, toxicity, vectors, warc
from stratapanel.llm.common import crc_remainder, materialised, scratch_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialised(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(rows, materialised(mixing.source_targets(rows)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans; ``spans`` holds these and the ones that the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.said(F.col("base")), 256).alias("base_sha256"), pii.said(F.col("spans")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of secrets, start:end of each (code points, end exclusive) and the highest score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.fit(docs))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"), F.coalesce(F.array_max(F.transform("secrets", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    manifest = warc.write(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    return warc.complete(manifest, warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and pre-token pattern of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trip(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.word_counts(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; the tests hold the others against brute force."""
    return dict(oracles.ORACLES)
