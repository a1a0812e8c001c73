"""A corpus pipeline over ``documents``: each stage reads all that the one before it kept.

Language identification drops documents without a recognisable language,
the near-duplicate stage keeps one document of each group, the suffix array cuts
passages that repeat, decontamination drops documents that hold benchmark
passages, and best-fit packing lays what is left out in training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from quire.llm.common import save, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or has no letter."""
    small_batches(spark)
    return language_id.known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts whose sets of five-word shingles have similarity 0.8 or more.

    Multi-index hashing of fingerprints alone would lose links, since texts at
    0.8 differ in ten bits on average, so this stage takes as candidates both
    the fingerprints within three bits and the texts that share a band of least
    hashes; each is verified on the whole texts.
    """
    small_batches(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each byte of a string of 400 bytes or of 51 words that starts twice in the corpus; every row stays."""
    small_batches(spark)
    return suffix_dedup.cut(docs, words=51)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words one in twenty or more lies in a 13-word window of a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2,048 words, a row per piece of a document with the piece's text as the stages before left it."""
    small_batches(spark)
    return packing.pack_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", recognise_language),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL has no XXH64, no automaton and no bin packing; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
