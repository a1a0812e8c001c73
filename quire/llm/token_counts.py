"""Token counts behind a digest cache."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import save, text_key, tidy

CACHE = "digest binary, n_tokens long, tokenizer string"
SLICE = 1 << 20  # characters that are encoded at once


def library_of(path: str) -> str:
    return {"json": "tokenizers", "model": "sentencepiece", "tiktoken": "tiktoken"}[path.rpartition(".")[2]]


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file's bytes and of its library's version; counts of another digest are never reused."""
    with open(path, "rb") as f:
        own = hashlib.sha256(f.read())
    library = library_of(path)
    own.update(f"{library} {version(library)}".encode())
    return own.hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts: whole texts, no added tokens, the library's defaults for special strings."""
    library = library_of(path)
    if library == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    if library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(e.encode_ordinary(x)) for x in texts]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= SLICE:
            yield part
            part, held = [], 0
    if part:
        yield part


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        for b in batches:
            found = [n for part in _slices(b["content"].tolist()) for n in count(part)]
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": pd.Series(found, dtype="int64")})

    return run


def _cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer, a row per digest: runs side by side may have counted a text twice."""
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(
    docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", digests: DataFrame | None = None
) -> None:
    """Encode the distinct texts of ``docs`` that the cache has no count for, and append their counts to it.

    The cache is a Parquet table of ``digest, n_tokens``, partitioned by
    tokenizer digest. Digests alone are held against it; only texts that it
    lacks are moved, once each task, as copies meet in a grouping by digest
    with a map-side combine. Where those are few, Spark broadcasts their
    digests and drops all other texts where they are read. Writers may run side
    by side: a text that both count is one row when it is read. A run that is
    lost before its commit leaves the cache as it was. ``digests`` are those of
    the texts (``digest``) where they have been made already.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    own = tokenizer_digest(tokenizer_path)
    texts = docs.select(text_key(F.col(text_col)).alias("digest"), F.coalesce(text_col, F.lit("")).alias("content"))
    known = _cache(spark, cache_path, own).select("digest")
    asked = (texts if digests is None else digests).select("digest").distinct()
    misses = save(asked.join(known, "digest", "left_anti"), "misses")
    wanted = texts.join(misses, "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    counted = wanted.mapInPandas(_encode(tokenizer_path), "digest binary, n_tokens long")
    with tidy(spark):
        counted.withColumn("tokenizer", F.lit(own)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_bytes, n_tokens, over_limit``.

    The content is normalised as the cache sees it (null becomes empty) and as
    the tokenizer does it, whose file the tokenizer digest covers. Each
    distinct text is encoded once, whole. Rows that repeat an id or a text each
    get their count; empty and null texts have 0 bytes and 0 tokens, or what
    the tokenizer gives for nothing. Further columns are ignored.
    """
    rows = docs.select(
        F.col(id_col),
        text_key(F.col(text_col)).alias("digest"),
        F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"),
    )
    rows = save(rows, "digests")
    fill_cache(docs, tokenizer_path, cache_path, text_col, rows)
    known = _cache(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path))
    return rows.join(known, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
