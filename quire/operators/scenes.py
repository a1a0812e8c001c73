"""From labelled paragraph ranges to stitched scene records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip, word_count
from quire.functions.vocabulary import SCHEMA_VERSION


def without_noise(labels: DataFrame) -> DataFrame:
    """Labelled ranges that are no noise by type or title; nulls count as neither."""
    noise = F.coalesce(F.col("paragraph_type") == "noise", F.lit(False)) | F.coalesce(F.col("title") == "NOISE", F.lit(False))
    return labels.where(~noise)


def stitched(labels: DataFrame) -> DataFrame:
    """``book_id, scene, start, end, title, stitch_status`` of ranges joined over open ends.

    ``labels`` has ``book_id, ord, start_paragraph_index, end_paragraph_index,
    open_start_index, open_end_index, title``. A range joins the one before it
    where that one's end and its own start are open. A scene whose first range
    has an open start begins one paragraph earlier (never before 0); one whose
    last end is open is broken, else stitched if it has several ranges, else
    broken if its start was open, else complete. Scenes are numbered from 0.
    """
    book = Window.partitionBy("book_id").orderBy("ord")
    opens = F.coalesce(F.col("open_start_index"), F.lit(False))
    ends = F.coalesce(F.col("open_end_index"), F.lit(False))
    first = ~(opens & F.coalesce(F.lag(ends).over(book), F.lit(False)))
    grouped = labels.withColumn("_first", first.cast("int")).withColumn(
        "_group", F.sum("_first").over(book.rowsBetween(Window.unboundedPreceding, 0))
    )
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("_group")) - 1
    return joined(grouped).withColumn("scene", number).select(*STITCHED)


STITCHED = ["book_id", "scene", "start", "end", "title", "stitch_status"]


def joined(grouped: DataFrame) -> DataFrame:
    """``book_id, _group`` and the scene that the ranges of each such group make; a group is summed up in every task that has rows of it."""
    opens = F.coalesce(F.col("open_start_index"), F.lit(False))
    ends = F.coalesce(F.col("open_end_index"), F.lit(False))
    found = grouped.groupBy("book_id", "_group").agg(
        F.min_by("start_paragraph_index", "ord").alias("_start"),
        F.max_by("end_paragraph_index", "ord").alias("end"),
        F.min_by("title", "ord").alias("title"),
        F.min_by(opens, F.col("ord")).alias("_open"),
        F.max_by(ends, F.col("ord")).alias("_broken"),
        F.count(F.lit(1)).alias("_n"),
    )
    return found.select(
        "book_id",
        "_group",
        F.when(F.col("_open"), F.greatest(F.col("_start") - 1, F.lit(0))).otherwise(F.col("_start")).alias("start"),
        "end",
        "title",
        F.when(F.col("_broken"), "broken_stitch")
        .when(F.col("_n") > 1, "stitched")
        .when(F.col("_open"), "broken_stitch")
        .otherwise("complete")
        .alias("stitch_status"),
    )


BIN = 256  # paragraphs


def scene_text(scenes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``book_id, scene, text_html, word_count``: the paragraphs from start to end of each scene, those that exist.

    Scenes and paragraphs meet in bins of ``BIN`` paragraphs, so a scene costs
    its bins and not its length, and what lies beyond the book's last paragraph
    costs nothing. A range whose end lies before its start holds none.
    """
    held = paragraphs.select("book_id", F.col("idx").cast("long").alias("idx"), "text")
    last = held.groupBy("book_id").agg(F.max("idx").alias("_last"))
    cut = scenes.join(last, "book_id").select("book_id", "scene", F.col("start").alias("_s"), F.least("end", "_last").alias("_e"))
    bins = F.sequence(F.floor(F.col("_s") / BIN), F.floor(F.col("_e") / BIN))
    wanted = cut.where("_e >= _s").withColumn("_bin", F.explode(bins))
    found = wanted.join(held.withColumn("_bin", F.floor(F.col("idx") / BIN)), ["book_id", "_bin"]).where("idx between _s and _e")
    body = F.concat_ws(
        "</p><p>", F.transform(F.array_sort(F.collect_list(F.struct("idx", strip(F.col("text")).alias("t")))), lambda x: x["t"])
    )
    made = found.groupBy("book_id", "scene").agg(F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("text_html"))
    # scenes without any paragraph keep their row
    whole = scenes.select("book_id", "scene").join(made, ["book_id", "scene"], "left")
    whole = whole.withColumn("text_html", F.coalesce("text_html", F.lit("<p></p>")))
    return whole.withColumn("word_count", word_count(F.col("text_html")))


def linked(scenes: DataFrame, number: str = "scene") -> DataFrame:
    """Adds ``scene_id`` and the ids of the scenes before and after it in the book."""
    book = Window.partitionBy("book_id").orderBy(number)
    named = scenes.withColumn("scene_id", F.concat_ws("-", "book_id", F.col(number).cast("string")))
    return named.withColumns(
        {"prev_scene_id": F.lag("scene_id").over(book), "next_scene_id": F.lead("scene_id").over(book)}
    )


def neighbor_tones(scenes: DataFrame) -> DataFrame:
    """Adds ``prev_tone, next_tone`` from the scenes that the ids name; null where such a scene is absent."""
    tones = scenes.select("scene_id", "dominant_tone")
    before = tones.select(F.col("scene_id").alias("prev_scene_id"), F.col("dominant_tone").alias("prev_tone"))
    after = tones.select(F.col("scene_id").alias("next_scene_id"), F.col("dominant_tone").alias("next_tone"))
    bare = scenes.drop("prev_tone", "next_tone")
    return bare.join(before, "prev_scene_id", "left").join(after, "next_scene_id", "left")


def dense_neighbor_tones(scenes: DataFrame, order: str = "pos") -> DataFrame:
    """The same by one window, for whole books whose scenes follow one another without gaps."""
    book = Window.partitionBy("book_id").orderBy(order)
    return scenes.withColumns(
        {"prev_tone": F.lag("dominant_tone").over(book), "next_tone": F.lead("dominant_tone").over(book)}
    )


def records(labels: DataFrame, paragraphs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scene records of labelled books: 24 fields, with the facets still null.

    ``paragraphs`` has ``book_id, idx, text, chapter_title``; ``metadata`` one
    row per book as ``sources.catalog.metadata`` makes it. The chapter title is
    that of the paragraph where the scene starts.
    """
    scenes = linked(stitched(without_noise(labels)))
    titles = paragraphs.select("book_id", F.col("idx").cast("long").alias("start"), "chapter_title")
    full = (
        scenes.withColumn("start", F.col("start").cast("long"))
        .join(scene_text(scenes, paragraphs), ["book_id", "scene"])
        .join(titles, ["book_id", "start"], "left")
        .join(metadata.select(F.col("ID").alias("book_id"), F.struct(metadata.columns).alias("book_metadata")), "book_id", "left")
    )
    none = lambda kind="string": F.lit(None).cast(kind)
    return full.select(
        "scene_id", "book_id", "prev_scene_id", "next_scene_id",
        none().alias("dominant_tone"), none().alias("intensity"), none().alias("arc"),
        none("array<string>").alias("descriptors"), none().alias("prev_tone"), none().alias("next_tone"),
        F.col("title").alias("scene_title"), "chapter_title", "stitch_status",
        F.col("start").cast("int").alias("start_paragraph_index"), F.col("end").cast("int").alias("end_paragraph_index"),
        F.col("word_count").cast("int").alias("word_count"),
        F.col("book_metadata.Author").alias("author"), F.col("book_metadata.Language").alias("language"), "book_metadata",
        none().alias("summary"), "text_html", F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(False).alias("enriched"), none().alias("enrich_model"),
    )
