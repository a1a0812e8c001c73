"""The book catalog: a CSV file of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import display_date, flipped_name, parts_of, subjects
from quire.operators.upsert import latest

COLUMNS = ["Text#", "Title", "Authors", "Subjects", "Language", "Issued"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows as strings; of rows with one ``Text#`` the last stays: in the last file by path, then by place in it."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    # a multi-line file is never split, so within a file rows have rising numbers
    return last_wins(raw.withColumn("_n", F.struct("_metadata.file_path", F.monotonically_increasing_id())), "_n")


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """One row per ``Text#``, the last by ``order``; nulls become empty texts."""
    full = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in COLUMNS], F.col(order).alias("_order"))
    return latest(full, ["Text#"], ["_order"]).select(*COLUMNS)


def metadata(catalog: DataFrame, codes: DataFrame | None = None, link: str = "https://www.gutenberg.org/ebooks/") -> DataFrame:
    """One row of metadata per book; with ``codes`` (column ``code``) those alone, where an unknown one is an error."""
    rows = catalog
    if codes is not None:
        asked = codes.select(F.col("code").alias("Text#")).distinct().join(catalog, "Text#", "left")
        known = F.when(F.col("Title").isNull(), F.raise_error(F.concat(F.lit("not in the catalog: "), F.col("Text#"))).cast("string"))
        rows = asked.withColumn("Title", known.otherwise(F.col("Title")))
    authors = parts_of(F.col("Authors"))
    translators = F.filter(authors, lambda a: F.lower(a).contains("[translator]"))
    return rows.select(
        F.col("Text#").alias("ID"),
        F.concat(F.lit(link), F.col("Text#")).alias("Link"),
        flipped_name(F.get(authors, F.lit(0))).alias("Author"),
        flipped_name(F.get(translators, F.lit(0))).alias("Translator"),
        "Title",
        subjects(F.col("Subjects")).alias("Subjects"),
        display_date(F.col("Issued")).alias("Date"),
        "Language",
    )
