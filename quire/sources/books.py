"""Whole books as JSON lines: metadata and chunks come back as they went in."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.gates import pending
from quire.sources.tables import scratch, written

METADATA = "ID string, Link string, Author string, Translator string, Title string, Subjects array<string>, Date string, Language string"
CHUNK = (
    "chunk_index int, chapter_index int, chapter_heading string, part int, part_count int, "
    "context array<struct<idx: int, text: string>>, paragraphs array<struct<idx: int, text: string>>"
)


def _struct(fields: str) -> str:
    return f"struct<{fields}>"


LINE = f"book_id string, n_chunks long, metadata {_struct(METADATA)}, chunk {_struct(CHUNK)}"


def shelve(metadata: DataFrame, chunks: DataFrame, path: str) -> None:
    """Appends books to the shelf: a line with the metadata and the number of chunks, and a line for each chunk.

    ``metadata`` is that of ``sources.catalog.metadata``, ``chunks`` those of
    ``operators.paragraphs.chunks`` (``book_id`` is the metadata's ``ID``). A
    book without chunks is kept as such; chunks of a book without metadata are
    left out, as is a book without an id; of several metadata rows of one id
    any one counts. Nothing is rewritten: a book that is shelved again has two
    makings, of which ``shelf`` takes the last whole one. Chunks are written as
    they come, so a large book is as many tasks as its chunks are in, and
    metadata last, so a run that breaks leaves no book that looks whole.
    """
    fields = lambda ddl: [part.split()[0] for part in ddl.replace("struct<idx: int, text: string>", "s").split(", ")]
    folder = f"{path}/made={time.time_ns()}"
    books = metadata.where("ID is not null").dropDuplicates(["ID"])
    own = chunks.join(books.select(F.col("ID").alias("book_id")), "book_id", "left_semi")
    own = own.select("book_id", F.struct(*fields(CHUNK)).cast(_struct(CHUNK)).alias("chunk"))
    own.write.option("ignoreNullFields", "false").json(folder)
    counts = metadata.sparkSession.read.schema(LINE).json(folder).groupBy("book_id").agg(F.count("chunk").alias("n_chunks"))
    heads = books.select(F.col("ID").alias("book_id"), F.struct(*fields(METADATA)).cast(_struct(METADATA)).alias("metadata"))
    heads = heads.join(counts, "book_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    heads.write.mode("append").option("ignoreNullFields", "false").json(folder)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], "n_chunks long").write.mode("append").json(path)
    return spark.read.schema(f"{LINE}, made long").json(path)


def whole(lines: DataFrame) -> DataFrame:
    """``book_id, made``: of each book the last making that has its metadata and as many chunks as that says.

    A line that cannot be read is no line, so a damaged making does not count.
    """
    makings = lines.where("book_id is not null").groupBy("book_id", "made").agg(
        F.count("metadata").alias("_heads"), F.max("n_chunks").alias("_told"), F.count("chunk").alias("_found")
    )
    return makings.where("_heads = 1 and _told = _found").groupBy("book_id").agg(F.max("made").alias("made"))


def shelf(spark: SparkSession, path: str, books: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata, chunks) of the whole books of a shelf, or of those of ``books`` (``book_id``); an empty shelf has none."""
    lines = _lines(spark, path)
    chosen = whole(lines)
    if books is not None:
        chosen = chosen.join(books.select("book_id").distinct(), "book_id", "left_semi")
    kept = lines.join(chosen, ["book_id", "made"], "left_semi")
    return kept.where("metadata is not null").select("metadata.*"), kept.where("chunk is not null").select("book_id", "chunk.*")


def recalled(
    books: DataFrame, path: str, make: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
) -> tuple[DataFrame, DataFrame]:
    """(metadata, chunks) of ``books`` (``book_id``) by way of a shelf: only books that are not whole there are made.

    ``make`` gets the missing ids and gives their (metadata, chunks). With
    nothing missing it is not called and nothing is written.
    """
    spark = books.sparkSession
    missing = written(pending(books.select("book_id").distinct(), whole(_lines(spark, path)), "book_id"), scratch(spark, "missing"))
    if not missing.isEmpty():
        shelve(*make(missing), path)
    return shelf(spark, path, books)
