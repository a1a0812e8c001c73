"""Files that keep arriving: keyed upserts batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.sources.parts import ROWS_PER_PART, RangedTable


def upsert_into(path: str, keys: list[str], order: list[str], rows_per_part: int = ROWS_PER_PART) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest row per key, by ``order``, in the ranged table under ``path``.

    A batch rewrites the key ranges that it falls into, once, and then becomes
    the table's next version. The newest row stays whatever batch it came with,
    so late rows change nothing, and a batch that is run again, because the
    writer broke before or after that, makes the same rows again.
    """

    def write(batch: DataFrame, number: int) -> None:
        RangedTable(batch.sparkSession, path, batch.schema, keys, order, rows_per_part).upsert(batch)

    return write


def table(spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: list[str]) -> RangedTable:
    """The table that batches are merged into; empty before the first batch."""
    return RangedTable(spark, path, schema, keys, order)


def start(
    spark: SparkSession, source: str, schema: str | StructType, path: str, checkpoint: str, keys: list[str], order: list[str], files_per_batch: int = 1000
) -> StreamingQuery:
    """Upserts each new Parquet file of a folder; runs until what is there has been read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = rows.writeStream.foreachBatch(upsert_into(path, keys, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
