"""Stored tables: read-through caches, resumable work, status marks, JSON files."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.hooks import embedded
from quire.operators.gates import pending
from quire.operators.upsert import merged


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a local one only where master and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def ensure(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path``, made empty if it is not there."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_through(inputs: DataFrame, path: str, schema: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the cached table for ``inputs``: those whose key it lacks are made and appended first, the rest is only read."""
    spark = inputs.sparkSession
    cached = ensure(spark, path, schema)
    missing = pending(inputs, cached, key)
    make(missing).select(*cached.columns).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(inputs.select(key).distinct(), key, "left_semi")


def written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as written to ``path`` and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Files of a task count as soon as the task has ended, not with the last task of the job.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class Store:
    """Named tables of a folder, each given back as read from there.

    ``codec`` names the form of what checkpoints hold: those of another codec
    are not looked at.
    """

    def __init__(self, folder: str, every: int = 1000, codec: str = "1"):
        self.folder, self.every, self.codec = folder, every, codec

    def __call__(self, rows: DataFrame, name: str) -> DataFrame:
        return written(rows, f"{self.folder}/{name}")

    def _checkpoint(self, name: str) -> str:
        return f"{self.folder}/{name}/codec={self.codec}"

    def resumed(self, inputs: DataFrame, name: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``make`` gives for ``inputs``, from the named checkpoint as far as an earlier run has got.

        Only inputs without a row there, by ``keys`` (``book_id`` among them),
        or with a ``failure`` are made, by one job whose tasks have ``every`` of
        them each. A task's rows count when it ends, so a run that breaks loses
        what its open tasks had. The result has a row for each input; a failure
        is there until it succeeds. It reads the inputs of this run, so it is to
        be stored before the next one.

        Inputs are worked out and written once, and shuffled once on the way to
        their tasks. The checkpoint has a digest of all keys (``_key``); texts
        among the keys are not kept there beside it.
        """
        spark, path = inputs.sparkSession, self._checkpoint(name)
        digest = F.sha2(F.to_json(F.struct(*keys)), 256)
        schema = make(inputs.limit(0)).withColumns({"_run": F.lit(0).cast("long"), "_key": F.lit("")}).schema
        texts = [k for k in keys if k != "book_id" and schema[k].dataType.simpleString() == "string"]
        schema = T.StructType([f for f in schema if f.name not in texts])
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/gen=0")
        told = written(inputs.withColumn("_key", digest), f"{self.folder}/{name}-inputs")
        had = self.kept(spark, name, schema).where("failure is null").select("_key").distinct()
        tasks = -(-pending(told.select("_key"), had, "_key").count() // self.every)
        if tasks:
            # those that are done go the same way, so a task knows which of its inputs to leave out
            both = told.select("_key", F.struct(*inputs.columns).alias("_row")).unionByName(had, allowMissingColumns=True)
            left = both.repartition(tasks, "_key").groupBy("_key").agg(F.first("_row", ignorenulls=True).alias("_row"), F.count_if(F.col("_row").isNull()).alias("_had"))
            left = left.where("_had = 0").select("_row.*")
            made = make(left).withColumns({"_run": F.lit(time.time_ns()), "_key": digest}).select(*schema.names)
            made.write.options(**BY_TASK).parquet(f"{path}/gen={time.time_ns()}")
        rest = [c for c in schema.names if c not in (*keys, "_run", "_key")]
        last = F.max_by(F.struct(*rest), F.struct(F.col("failure").isNull(), "_run")).alias("_last")
        whole = told.groupBy("_key").agg(*[F.first(k).alias(k) for k in keys]).join(self.kept(spark, name, schema).groupBy("_key").agg(last), "_key")
        return whole.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])

    def kept(self, spark: SparkSession, name: str, schema) -> DataFrame:
        """What the named checkpoint has now of the columns of ``schema``; those that are not kept, as texts among the keys, are null."""
        return spark.read.schema(schema).parquet(self._checkpoint(name)).select(*schema.names)

    def clear(self, name: str, books: DataFrame) -> None:
        """Drops what the named checkpoint has of ``books`` (``book_id``), whose results are stored elsewhere, and all of other codecs.

        What stays is written anew before the rest is deleted; a break between
        leaves rows twice, which changes no result.
        """
        spark, path, now = books.sparkSession, self._checkpoint(name), f"gen={time.time_ns()}"
        rows = spark.read.parquet(path).drop("gen")
        rows.join(books.select("book_id").distinct(), "book_id", "left_anti").select(*rows.columns).write.parquet(f"{path}/{now}")
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        own = top.suffix(f"/codec={self.codec}")
        gone = [s.getPath() for s in files.listStatus(top) if s.getPath().getName() != own.getName()]
        gone += [s.getPath() for s in files.listStatus(own) if s.getPath().getName() != now]
        for old in gone:  # a folder for each run
            files.delete(old, True)

    def books(self, rows: DataFrame, name: str) -> DataFrame:
        """The named table with the books of ``rows`` written anew; what it has of other books stays.

        Nothing is rewritten: rows are appended as one making, and of a book
        the last making counts. So there is a folder for each run, not for each book.
        """
        spark, path, now = rows.sparkSession, f"{self.folder}/{name}", time.time_ns()
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{path}/making=0")
        rows.write.parquet(f"{path}/making={now}")
        found = spark.read.schema(T.StructType([*rows.schema, T.StructField("making", T.LongType())])).parquet(path)
        last = found.groupBy(F.struct("book_id").alias("_book")).agg(F.max("making").alias("making"))
        return found.withColumn("_book", F.struct("book_id")).join(last, ["_book", "making"], "left_semi").select(*rows.columns)


def stored(folder: str, every: int = 1000) -> Store:
    return Store(folder, every)


def remembered(path: str, version: str) -> Callable:
    """``hooks.embedded`` with a memory under ``path``: a text that the model of that ``version`` has embedded once is not embedded again.

    Vectors are kept by digest of the text and by version; equal texts of a
    table are embedded once, and those of a task count when it ends.
    """
    where = f"{path}/model-{hashlib.sha256(version.encode()).hexdigest()[:16]}"

    def embedded_once(rows: DataFrame, text: str, out: str, embed: Callable, **options) -> DataFrame:
        spark = rows.sparkSession
        digest = F.when(F.col(text).isNotNull(), F.sha2(text, 256))
        kept = ensure(spark, where, "_digest string, _vector array<float>")
        fresh = rows.select(digest.alias("_digest"), F.col(text).alias("_text")).where("_digest is not null").dropDuplicates(["_digest"])
        fresh = written(pending(fresh, kept, "_digest"), scratch(spark, "texts"))
        if not fresh.isEmpty():
            made = embedded(fresh, "_text", "_vector", embed, **options).select("_digest", "_vector")
            made.write.options(**BY_TASK).mode("append").parquet(where)
        # two scans of one path are one to Spark, also where files came in between, unless their options differ
        found = spark.read.schema(kept.schema).option("readAt", time.time_ns()).parquet(where)
        found = found.dropDuplicates(["_digest"]).withColumnRenamed("_vector", out)
        return rows.withColumn("_digest", digest).join(found, "_digest", "left").drop("_digest")

    return embedded_once


def read_json(spark: SparkSession, path: str, schema: str, corrupt: str = "_corrupt_record", lines: bool = False) -> DataFrame:
    """Records of JSON files with ``_file``; what cannot be parsed comes as null fields and its text in ``corrupt``.

    A file is one record or a list of them; with ``lines``, as ``write_json`` makes it, a record a line.
    """
    full = f"{schema}, {corrupt} string"
    rows = spark.read.schema(full).option("multiLine", not lines).option("columnNameOfCorruptRecord", corrupt).json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def scene_files(spark: SparkSession, folder: str, schema: str, ids: list[str] | None = None) -> DataFrame:
    """Scene records of ``pg<id>-s.json`` files, all or some, with ``book_id`` from the name."""
    rows = read_json(spark, f"{folder}/pg*-s.json", schema)
    rows = rows.withColumn("book_id", F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"^pg(.*)-s\.json$", 1))
    return rows.where(F.col("book_id").isin(ids)) if ids is not None else rows


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON file set per book, a record a line; nulls are written, other books' files stay.

    Where nothing is there yet, each task puts its books' files in place when
    it ends; replacing books of a path that is there is the driver's work, a book at a time.
    """
    spark = rows.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top)
    writer = rows.repartition("book_id").write.option("ignoreNullFields", "false").partitionBy("book_id")
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if there else writer.mode("append").options(**BY_TASK)
    writer.json(path)


def write_small(value, path: str) -> None:
    """A driver-side JSON file that is either whole or not there."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def read_small(path: str, default=None):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, json.JSONDecodeError):
        return default


def read_text(path: str, default: str | None = None) -> str | None:
    """A small driver-side text file, or ``default`` if it is not there."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return default


def marked(status: DataFrame, books: DataFrame, state: str = "completed") -> DataFrame:
    """The status table (``book_id, status``) with ``books`` in a state."""
    return merged(status, books.select("book_id", F.lit(state).alias("status")).distinct(), ["book_id"])


def unmarked(status: DataFrame, books: DataFrame) -> DataFrame:
    return pending(status, books, "book_id")


def shown(hits: DataFrame) -> DataFrame:
    """Search hits as they are printed: scores to three places, descriptors on one line."""
    tags = ["dominant_tone", "intensity", "arc", "scene_title", "summary"]
    here = [c for c in tags if c in hits.columns]
    listed = [F.array_join("descriptors", ", ").alias("descriptors")] if "descriptors" in hits.columns else []
    return hits.select(F.round("score", 3).alias("score"), "scene_id", *here, *listed)
