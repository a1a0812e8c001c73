"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; a local one only where master and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores as it takes to be no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the session's Arrow batches to ``rows``: texts differ in length by orders of magnitude, workers' memory doesn't."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it Spark removes a query's shuffle files as soon as that query has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` a column, and read it back: that cuts its lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text) -> F.Column:
    """16 bytes of SHA-256 that stand for a text; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src long, dst long)`` by alternating large-star and small-star rounds.

    Returns ``node, root`` for each node that has a link to another one; root is
    the smallest node of the component. Each round is two aggregations and two
    joins on node ids, saved to the shared folder. A node with very many
    neighbours is only ever aggregated with ``min`` or met in a plain join.
    Self-links and repeated links change nothing; no links give no rows.
    """
    links = save(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(),
        "links",
    )
    for _ in range(max_rounds):
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            links.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        ends = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 or (below > 0 and above > 0)").isEmpty():
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
