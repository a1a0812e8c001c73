"""Lookups over the scene table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import position
from quire.functions.vocabulary import FILTERS


def condition(filters: dict) -> Column:
    """AND of equalities and, for lists, memberships; an empty list and a null match nothing, an unknown column is a KeyError."""

    def one(name: str, value) -> Column:
        if name not in FILTERS:
            raise KeyError(name)
        kind = "boolean" if name == "enriched" else "string"
        fit = lambda v: F.lit(v).cast(kind)
        if isinstance(value, (list, tuple, set, frozenset)):
            known = [fit(v) for v in value if v is not None]
            return F.col(name).isin(*known) if known else F.lit(False)
        return F.lit(False) if value is None else F.col(name) == fit(value)

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()], F.lit(True))


def find(scenes: DataFrame, limit: int | None = None, order: bool = True, **filters) -> DataFrame:
    """Scenes that pass all filters, in reading order unless told otherwise; a negative limit means none."""
    found = scenes.where(condition(filters))
    if order:
        found = found.orderBy(F.asc_nulls_first("book_id"), F.asc_nulls_first("pos"), "scene_id")
    return found.limit(limit) if limit is not None and limit >= 0 else found


def get(scenes: DataFrame, scene_id: str) -> DataFrame:
    return scenes.where(F.col("scene_id") == scene_id)


def count(scenes: DataFrame, **filters) -> DataFrame:
    return scenes.where(condition(filters)).agg(F.count(F.lit(1)).alias("n"))


def tally(scenes: DataFrame, column: str) -> DataFrame:
    """Rows by value of a filterable column, nulls as a value of their own, most frequent first."""
    if column not in FILTERS:
        raise KeyError(column)
    return scenes.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def neighbors(scenes: DataFrame, scene_id: str, before: int = 1, after: int = 1) -> DataFrame:
    """The scene and those around it in its book, in order; nothing for an unknown id."""
    at = get(scenes, scene_id).select(F.col("book_id").alias("_book"), F.col("pos").alias("_pos")).limit(1)
    near = (F.col("book_id") == F.col("_book")) & F.col("pos").between(F.col("_pos") - before, F.col("_pos") + after)
    return scenes.join(F.broadcast(at), near).drop("_book", "_pos").orderBy("pos")  # one row


def windows(scenes: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """For every scene at once: ``scene_id`` and the ids around it, itself included, as far as positions reach."""
    offsets = F.sequence(F.lit(-before), F.lit(after))
    wanted = scenes.select("scene_id", "book_id", F.explode(F.transform(offsets, lambda o: F.col("pos") + o)).alias("pos"))
    other = scenes.select("book_id", "pos", F.col("scene_id").alias("near"))
    found = wanted.join(other, ["book_id", "pos"]).groupBy("scene_id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "near")))
    return found.agg(F.transform(listed, lambda x: x["near"]).alias("around"))


def mirror(records: DataFrame) -> DataFrame:
    """The 23 columns of the relational table, with ``pos`` from the id; rows without an id are left out."""
    return records.where(F.coalesce("scene_id", F.lit("")) != "").select(
        "scene_id", "book_id", position(F.col("scene_id")).alias("pos"), "prev_scene_id", "next_scene_id", "author", "language",
        "dominant_tone", "prev_tone", "next_tone", "intensity", "arc", "stitch_status", "word_count",
        "start_paragraph_index", "end_paragraph_index", "scene_title", "chapter_title",
        F.to_json(F.coalesce("descriptors", F.array().cast("array<string>"))).alias("descriptors"), "summary",
        F.coalesce(F.col("enriched").cast("int"), F.lit(0)).alias("enriched"), "enrich_model",
        F.col("schema_version").cast("string").alias("schema_version"),
    )


def reinflated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("descriptors", F.from_json("descriptors", "array<string>"))
