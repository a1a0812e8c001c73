"""Book archives that keep arriving: each file is parsed once, and a book's newest archive stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import paragraphs
from quire.operators.upsert import latest
from quire.sources import archive
from quire.sources.parts import RangedTable

FILES = "path string, modificationTime timestamp, length long, content binary"
BOOKS = "book_id string, modified timestamp, path string, batch string"


def books(spark: SparkSession, path: str) -> RangedTable:
    """``BOOKS``: which file each book's paragraphs are of, and which batch brought it."""
    return RangedTable(spark, f"{path}/books", BOOKS, ["book_id"], ["modified", "path", "batch"])


def table(spark: SparkSession, path: str) -> DataFrame:
    """Numbered paragraphs of the newest archive of each book."""
    rows = spark.read.schema("book_id string, chapter int, heading string, idx int, text string, batch string").parquet(f"{path}/paragraphs")
    return rows.join(books(spark, path).table().select("book_id", "batch"), ["book_id", "batch"], "left_semi").drop("batch")


def into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: paragraphs go to a folder of their own, and count once the table of books names it.

    So a book changes at once and as a whole, also to none; a batch that is run
    again writes another folder, and what a broken one wrote is never read. A
    file that is older than the one a book has, and all but the newest of a
    batch, change nothing. Files that are no zip are passed over.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, named = batch.sparkSession, f"{number}-{uuid.uuid4().hex}"
        files = archive.named(batch).where(F.substring("content", 1, 2) == F.lit(b"PK"))
        told = files.select("book_id", F.col("modificationTime").alias("modified"), "path")
        newest = latest(told, ["book_id"], ["modified", "path"])
        had = books(spark, path).table().select("book_id", F.struct("modified", "path").alias("_had"))
        fresh = newest.join(had, "book_id", "left").where(F.col("_had").isNull() | (F.struct("modified", "path") >= F.col("_had"))).drop("_had")
        own = files.join(fresh.select("book_id", "path"), ["book_id", "path"], "left_semi")
        rows = paragraphs.numbered(paragraphs.kept_segments(archive.paragraphs(archive.pages(own))))
        rows.write.parquet(f"{path}/paragraphs/batch={named}")
        books(spark, path).upsert(fresh.withColumn("batch", F.lit(named)))

    return write


def start(spark: SparkSession, folder: str, path: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Takes in the archives of a folder that have not been taken in before; runs until what is there has been read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*zip").option("maxFilesPerTrigger", files_per_batch)
    writer = files.load(folder).writeStream.foreachBatch(into(path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
