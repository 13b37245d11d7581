"""From raw documents to training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from citegrove.llm.common import small_batches, stored, table
from citegrove.llm.queries import language_models


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is believed to be in a learned language; rejected ones go. lang is left as it was.

    The decision is made where each row stands: no text is joined or moved."""
    small_batches(spark)
    return language_id.accepted_rows(language_models(docs), docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest doc_id."""
    return exact_dedup.without_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard similarity of 0.8 or more), of the least doc_id."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources that are small for their weight again, up to twice on average."""
    return mixing.mixed(docs, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, none of which crosses documents; each use of a document is packed."""
    small_batches(spark)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("language_id", identify_language), ("exact_dedup", dedup_exact), ("jaccard_join", dedup_near),
          ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
