"""Parquet tables in parts that are replaced one by one, each change a new version.

What a version consists of is one row of the table ``versions``: appending that
row is what makes a change count. A writer that breaks before it leaves files
that nobody reads, and a reader keeps to the version it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.operators.upsert import latest

PART = "_part"
#: Of each part: its number within ``folder``, rows, the JSON of its lowest key (null: no limit) and of what is known of it.
VERSIONS = "version long, parts array<struct<part: int, folder: string, rows: long, low: string, stats: string>>"
KEY_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
ROWS_PER_PART = 200_000
MOST_PARTS = 4096  # beyond as many, parts grow with the table
SAMPLE = 20_000  # keys that ranges are cut by


@dataclass(frozen=True)
class Part:
    part: int
    folder: str | None
    rows: int
    low: str | None = None
    stats: str | None = None


class Parts:
    """The versions of a table under ``path``; there is one writer at a time, readers may be many."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def newest(self) -> tuple[int, list[Part]]:
        """(number of the newest version, its parts); 0 and none before the first."""
        try:
            made = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        last, parts = made.agg(F.max("version"), F.max_by("parts", "version")).first()
        return last or 0, [Part(*p) for p in parts or []]

    def read(self, parts: Sequence[Part]) -> DataFrame:
        """The rows of some parts; only their folders are looked at."""
        paths = [f"{self.path}/{p.folder}/{PART}={p.part}" for p in parts if p.folder]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, *within: str, bloom: Sequence[str] = ()) -> str:
        """A new folder with ``rows`` by their ``_part``, sorted ``within`` each; ``bloom`` filters are kept of the named columns.

        Spark deals the rows to tasks by part and splits a part that is too large for one.
        """
        folder = f"data/{uuid.uuid4().hex}"
        writer = rows.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *within).write.partitionBy(PART)
        for column in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def written(self, folder: str) -> DataFrame:
        """A folder as written, with ``_part``."""
        return self.spark.read.schema(StructType([*self.schema, StructField(PART, IntegerType())])).parquet(f"{self.path}/{folder}")

    def commit(self, version: int, parts: Sequence[Part]) -> None:
        row = json.dumps({"version": version, "parts": [asdict(p) for p in parts]})
        told = self.spark.range(1).select(F.from_json(F.lit(row), VERSIONS).alias("v")).select("v.*")
        told.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def forget(self, keep: int = 2) -> int:
        """Deletes the folders that none of the ``keep`` newest versions has; how many. No older version can be read after it."""
        made = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        last = made.orderBy(F.desc("version")).limit(keep)
        held = {r.folder for r in last.select(F.explode("parts.folder").alias("folder")).distinct().collect()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in files.listStatus(root) if f"data/{s.getPath().getName()}" not in held]
        for path in gone:
            files.delete(path, True)
        return len(gone)


class RangedTable(Parts):
    """One row per key, in parts that are ranges of keys: a batch rewrites the ranges that its keys fall into, and no others.

    ``order`` says which of two rows of a key is the newer; it stays whatever
    batch it comes with. Ranges are cut by keys sampled from the rows, into
    parts of about ``rows_per_part``, and cut again where one has grown to twice
    as many. Null keys are keys and come first.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: list[str], rows_per_part: int = ROWS_PER_PART):
        super().__init__(spark, path, schema)
        self.keys, self.order, self.rows_per_part = keys, order, rows_per_part
        self.key_type = f"struct<{', '.join(f'`{k}`: {self.schema[k].dataType.simpleString()}' for k in keys)}>"

    def _key(self) -> Column:
        return F.struct(*[F.col(f"`{k}`") for k in self.keys])

    def place(self, lows: Sequence[str | None]) -> Column:
        """The number of the range that a row's key lies in, by bisection; ``lows``: JSON of the lowest keys of all ranges, the first is not looked at."""
        if len(lows) < 2:
            return F.lit(0)
        bounds = F.from_json(F.lit(f"[{', '.join(lows[1:])}]"), f"array<{self.key_type}>", KEY_JSON)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(lows).bit_length()))])
        ahead = lambda at, step: F.when(F.get(bounds, at + step - 1) <= self._key(), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), ahead)

    def _cut(self, rows: DataFrame, lows: list[str | None], sizes: dict[int, int], target: int) -> dict[int, list[str]]:
        """For each range of ``sizes`` (rows that it has) the JSON of the keys that cut it into parts of about ``target``."""
        keys = rows.select(self._key().alias("_key"), self.place(lows).alias("_at")).where(F.col("_at").isin(list(sizes)))
        some = keys.orderBy(F.xxhash64("_key")).limit(SAMPLE).orderBy("_key").select("_at", F.to_json("_key", KEY_JSON))
        found: dict[int, list[str]] = {p: [] for p in sizes}
        for p, k in some.collect():  # SAMPLE keys at most
            found[p].append(k)
        cuts = {}
        for p, own in found.items():
            n = -(-sizes[p] // target)
            borders = [own[len(own) * j // n] for j in range(1, n)] if own else []
            cuts[p] = [b for b in dict.fromkeys(borders) if b != lows[p] and (lows[p] is not None or b != own[0])]
        return cuts

    def upsert(self, batch: DataFrame, bloom: Sequence[str] = ()) -> dict[str, int]:
        """Merges a batch; ``parts`` and ``rows`` that were written, out of ``of`` parts. An empty batch writes nothing."""
        version, had = self.newest()
        parts = had or [Part(0, None, 0)]
        lows = [p.low for p in parts]
        fresh = latest(batch, self.keys, self.order).persist()
        try:
            hit = dict(fresh.groupBy(self.place(lows).alias("_at")).agg(F.count(F.lit(1))).collect())
            if not hit:
                return {"parts": 0, "rows": 0, "of": len(had)}
            sizes = {p: n + parts[p].rows for p, n in hit.items()}
            target = max(self.rows_per_part, (sum(p.rows for p in parts) + sum(hit.values())) // MOST_PARTS)
            large = {p: n for p, n in sizes.items() if n > (2 * target if had else target)}
            before = self.read([parts[p] for p in hit])
            cuts = {}
            if large:
                cuts = self._cut(self.read([parts[p] for p in large]).unionByName(fresh.select(*self.schema.names)), lows, large, target)
            ahead: list[tuple[str | None, Part | None]] = []  # the ranges to come, with their parts where nothing changes
            for p, part in enumerate(parts):
                ahead += [(low, None) for low in [part.low, *cuts.get(p, [])]] if p in hit else [(part.low, part)]
            place = self.place([low for low, _ in ahead])
            whole = latest(before.unionByName(fresh.select(*self.schema.names)), self.keys, self.order).withColumn(PART, place)
            folder = self.write(whole, *self.keys, bloom=bloom)
        finally:
            fresh.unpersist()
        known = {r[PART]: r.n for r in self.written(folder).groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}
        made = [part or Part(p, folder if p in known else None, known.get(p, 0), low) for p, (low, part) in enumerate(ahead)]
        self.commit(version + 1, made)
        return {"parts": len(known), "rows": sum(known.values()), "of": len(made)}

    def table(self) -> DataFrame:
        """All rows of the newest version."""
        return self.read(self.newest()[1])

    def between(self, low: Sequence, high: Sequence) -> DataFrame:
        """Rows with keys from ``low`` to ``high`` (numbers, texts or nulls; fewer values than keys stand for all that begin so).

        Only the parts whose ranges the keys can lie in are read.
        """
        rank = lambda key: [(v is not None, v) for v in key]
        low, high = rank(low), rank(high)
        parts = self.newest()[1]
        lows = [rank(json.loads(p.low).values()) if p.low else None for p in parts]
        ends = [*lows[1:], None]
        hit = [p for p, a, b in zip(parts, lows, ends) if (a is None or a[: len(high)] <= high) and (b is None or b >= low)]
        at = lambda v, n: F.struct(*[F.lit(x).cast(self.schema[k].dataType).alias(k) for (_, x), k in zip(v, self.keys[:n])])
        head = lambda n: F.struct(*[F.col(f"`{k}`") for k in self.keys[:n]])
        return self.read(hit).where((head(len(low)) >= at(low, len(low))) & (head(len(high)) <= at(high, len(high))))
