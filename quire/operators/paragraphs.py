"""From segments of paragraphs to bounded chunks with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.vocabulary import CHUNK_CHARS, LOOKBACK, MIN_SEGMENT_CHARS


def lines(docs: DataFrame, book: str, text: str) -> DataFrame:
    """``book_id, segment, heading, para, text``: the non-empty lines of each text as paragraphs of one segment."""
    cut = docs.select(F.col(book).cast("string").alias("book_id"), F.posexplode(F.split(text, "\n")).alias("para", "text"))
    return cut.where("text <> ''").select(
        "book_id", F.lit(0).alias("segment"), F.lit(None).cast("string").alias("heading"), "para", "text"
    )


def kept_segments(paragraphs: DataFrame, least: int = MIN_SEGMENT_CHARS) -> DataFrame:
    """Paragraphs of the segments that have ``least`` characters or more."""
    sizes = paragraphs.groupBy("book_id", "segment").agg(F.sum(F.length("text")).alias("_size"))
    return paragraphs.join(sizes.where(F.col("_size") >= least).drop("_size"), ["book_id", "segment"], "left_semi")


def numbered(paragraphs: DataFrame) -> DataFrame:
    """Adds ``idx``, from 0 over the whole book, and ``chapter``, the kept segments from 0."""
    book = Window.partitionBy("book_id").orderBy("segment", "para")
    return paragraphs.select(
        "book_id",
        (F.dense_rank().over(Window.partitionBy("book_id").orderBy("segment")) - 1).alias("chapter"),
        "heading",
        (F.row_number().over(book) - 1).alias("idx"),
        "text",
    )


def greedy_starts(sizes: Column, limit: int) -> Column:
    """Where greedy parts begin (places from 1) in an array of sizes: a part never holds more than ``limit``, unless one item alone does.

    The fold keeps the size of the open part and the starts so far, so what it
    copies grows with the parts and not with the items.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"), F.array().cast("array<long>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        fresh = (s["at"] == 0) | (s["size"] + x > limit)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(fresh, x).otherwise(s["size"] + x).alias("size"),
            F.when(fresh, F.concat(s["starts"], F.array(s["at"] + 1))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, start, step, lambda s: s["starts"])


def packed(items: DataFrame, group: list[str], order: str, size: Column, limit: int) -> DataFrame:
    """``group, order, part`` (from 1), ``part_count``: items of a group, in order, dealt to greedy parts.

    Only places and sizes are gathered, a group at a time; texts stay where they are.
    """
    listed = items.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("n")))).alias("_items")
    )
    starts = greedy_starts(F.transform("_items", lambda i: i["n"]), limit)
    parts = listed.select(*group, "_items", starts.alias("_starts")).select(
        *group, "_items", F.size("_starts").alias("part_count"), "_starts", F.posexplode("_starts").alias("_p", "_first")
    )
    after = F.coalesce(F.get("_starts", F.col("_p") + 1), F.size("_items") + 1)
    owned = F.slice("_items", F.col("_first").cast("int"), (after - F.col("_first")).cast("int"))
    return parts.select(*group, (F.col("_p") + 1).alias("part"), "part_count", F.explode(owned).alias("_i")).select(
        *group, F.col("_i.o").alias(order), "part", "part_count"
    )


def chunks(paragraphs: DataFrame, limit: int = CHUNK_CHARS, lookback: int = LOOKBACK) -> DataFrame:
    """Chunks of numbered paragraphs: parts of chapters with the ``lookback`` paragraphs before their first one.

    Where chunks begin is settled by numbers: a row that marks each beginning is
    sorted in among the book's paragraphs, which so learn their chunk, and what
    stands before it, on the one way to their book.
    """
    chunk = ["book_id", "chapter", "part", "part_count"]
    rows = paragraphs.where("book_id is not null").select("book_id", "chapter", "heading", "idx", "text")
    # sizes ask for the headings too: with the same columns on both ways the shuffle that numbered the paragraphs is made once
    sizes = rows.select("book_id", "chapter", "idx", F.length(F.coalesce("text", "heading")).alias("_n"))
    own = packed(sizes, ["book_id", "chapter"], "idx", F.col("_n"), limit)
    begins = own.groupBy(*chunk).agg(F.min("idx").alias("idx"))
    place = Window.partitionBy("book_id").orderBy("chapter", "part")
    begins = begins.withColumn("chunk_index", F.row_number().over(place) - 1)
    marks = begins.select("book_id", "idx", F.struct("part", "part_count", "chunk_index").alias("_chunk"))
    book = Window.partitionBy("book_id").orderBy("idx", F.col("_chunk").isNull())
    running = book.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.unionByName(marks, allowMissingColumns=True).select(
        "book_id", "chapter", "heading", "idx", "text", F.col("_chunk").isNull().alias("_paragraph"),
        F.last("_chunk", ignorenulls=True).over(running).alias("_chunk"),
        F.lag(F.col("_chunk").isNotNull()).over(book).alias("_first"),
    )
    item = F.struct("idx", "text")
    before = F.collect_list(item).over(Window.partitionBy("book_id").orderBy("idx").rowsBetween(-lookback, -1)) if lookback > 0 else F.array_remove(F.array(item), item)
    near = F.filter(before, lambda p: p["idx"] >= F.col("idx") - lookback)
    placed = marked.where("_paragraph").withColumn("_before", F.when(F.col("_first"), near))
    return placed.groupBy("book_id", "chapter", "_chunk").agg(
        F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("idx"))).alias("chapter_heading"),
        F.first("_before", ignorenulls=True).alias("context"),
        F.array_sort(F.collect_list(item)).alias("paragraphs"),
    ).select(
        "book_id", "_chunk.chunk_index", F.col("chapter").alias("chapter_index"), "chapter_heading", "_chunk.part", "_chunk.part_count", "context", "paragraphs"
    )


def _named(items: str) -> Column:
    return F.transform(items, lambda p: F.struct(p["idx"].alias("index"), p["text"].alias("text")))


def labelling_payload(chunks: DataFrame) -> DataFrame:
    """``book_id, chunk_index, payload``: the JSON that a labeller gets for each chunk, nulls kept."""
    body = F.struct(
        F.col("chapter_heading").alias("chapter_title"),
        F.concat_ws("/", "part", "part_count").alias("section_within_chunk"),
        _named("context").alias("read_only_context_paragraphs"),
        F.size("paragraphs").alias("number_of_indexed_paragraphs"),
        _named("paragraphs").alias("indexed_paragraphs"),
    )
    return chunks.select("book_id", "chunk_index", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def inspection_payload(chunks: DataFrame, pretty: bool = False) -> DataFrame:
    """The whole chunk as JSON with its counts, for people to look at."""
    body = F.struct(
        "chunk_index", "chapter_index", "chapter_heading", "part", "part_count",
        F.size("context").alias("context_count"), F.size("paragraphs").alias("paragraph_count"),
        _named("context").alias("context"), _named("paragraphs").alias("paragraphs"),
    )
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return chunks.select("book_id", "chunk_index", F.to_json(body, options).alias("payload"))


INSPECTED = (
    "chunk_index int, chapter_index int, chapter_heading string, part int, part_count int, context_count int, paragraph_count int, "
    "context array<struct<index: int, text: string>>, paragraphs array<struct<index: int, text: string>>"
)


def from_inspection(payloads: DataFrame) -> DataFrame:
    """Chunks as they were before ``inspection_payload``; a payload that is no such JSON is an error."""
    read = F.from_json("payload", INSPECTED, {"mode": "FAILFAST"})
    back = lambda c: F.transform(c, lambda p: F.struct(p["index"].alias("idx"), p["text"].alias("text")))
    rows = payloads.select("book_id", read.alias("c"))
    return rows.select(
        "book_id", "c.chunk_index", "c.chapter_index", "c.chapter_heading", "c.part", "c.part_count",
        back(F.col("c.context")).alias("context"), back(F.col("c.paragraphs")).alias("paragraphs"),
    )


def payload_dump(chunks: DataFrame) -> DataFrame:
    """``book_id, payloads``: the inspection payloads of a book's chunks in order, for ``sources.tables.write_json``."""
    rows = inspection_payload(chunks).groupBy("book_id")
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "payload")))
    return rows.agg(F.transform(listed, lambda x: x["payload"]).alias("payloads"))
