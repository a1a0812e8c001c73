"""Keyed writes: the newest row of a key stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``: an aggregation with a map-side combine, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def merged(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of its own where keys are equal; within a batch the last by ``order`` wins."""
    fresh = latest(batch, keys, order) if order else batch.dropDuplicates(keys)
    return table.join(fresh.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def effects(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row with what ``merged`` would do: ``n_rows`` of the batch by key, ``n_new`` of them, ``n_replaced``."""
    fresh = batch.select(*keys).distinct().join(table.select(*keys, F.lit(1).alias("_had")).distinct(), keys, "left")
    return fresh.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_had").isNull()).alias("n_new"), F.count("_had").alias("n_replaced")
    )


def replaced(table: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """``table`` after the rows of ``batch``, in ``order``, under two unique keys: ``scene_id`` and (``book_id``, ``pos``).

    Each row removes all rows before it that have its id or its place, so a row
    stays if it is the last of its id and the last of its place. Ids may move
    to other places. Rows of ``table`` come before all of the batch; rows
    without an id are left out, those without a place only meet by id.
    """
    rows = table.withColumn("_new", F.lit(0)).unionByName(batch.select(*table.columns).withColumn("_new", F.lit(1)))
    rows = rows.where(F.coalesce("scene_id", F.lit("")) != "").withColumn("_at", F.struct("_new", *order, "scene_id"))
    last = latest(rows, ["scene_id"], ["_at"])
    place = F.col("book_id").isNotNull() & F.col("pos").isNotNull()
    held = rows.where(place).groupBy("book_id", "pos").agg(F.max("_at").alias("_last"))
    stays = last.join(held, ["book_id", "pos"], "left").where(~place | (F.col("_at") == F.col("_last")))
    return stays.select(*table.columns)


def write_books(rows: DataFrame, path: str) -> None:
    """Rewrites only the books that ``rows`` has, by dynamic partition overwrite."""
    (
        rows.repartition("book_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("book_id")
        .parquet(path)
    )
