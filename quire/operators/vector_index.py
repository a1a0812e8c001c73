"""A stored vector index: cells from spherical k-means, a part of the table each.

A query goes to the cells whose centre and radius let them hold one of its
``k`` nearest vectors, and is compared there with the vectors themselves. By
those bounds the answer is exact; with a limit on the cells it is not, and
``recall`` measures what is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.search import best_of_block, sound
from quire.sources.parts import PART, Part, Parts
from quire.sources.tables import scratch, written

SAMPLE_ROWS = 20_000  # vectors that the centres are fitted to
MOST_CELLS = 4096
ROUNDS = 10
BLOCK = 4096  # vectors, and queries, of a cell that meet in one task
SLACK = 1e-7  # cosines are not known better than that


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, cosine with it) of each row."""
    own, near = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), step):
        cosines = x[at : at + step] @ centres.T
        own[at : at + step] = cosines.argmax(axis=1)
        near[at : at + step] = cosines.max(axis=1)
    return own, near


def spherical_centres(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of at most ``cells`` cells of unit vectors, by k-means from evenly spread rows; empty cells are dropped."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int))]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest(x, centres)[0], x)
        size = np.sqrt((sums * sums).sum(axis=1))
        moved = sums[size > 1e-12] / size[size > 1e-12][:, None]
        still = moved.shape == centres.shape and np.abs(moved - centres).max() < 1e-6
        centres = moved
        if still:
            break
    return centres


def bounds(cosines: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The greatest cosine that a query can have with a vector of a cell, by those of query and centre and of centre and farthest vector."""
    angle = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(angle, 0.0)) + SLACK


class VectorIndex:
    """Rows ``row, v`` and the columns of ``extra`` under ``path``, by cell.

    ``kind`` is the type of ``row``, ``dim`` the length of the vectors. Vectors
    that are null, zero, of another length or hold null or non-finite
    components are not in the index, and as queries have no answer.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str, dim: int, extra: str = ""):
        self.kind, self.dim = kind, dim
        self.parts = Parts(spark, path, f"row {kind}, v array<double>" + (f", {extra}" if extra else ""))

    def build(self, rows: DataFrame, cells: int | None = None) -> None:
        """A new version of the index with ``rows`` (one row for each id), whatever it had before.

        Unless told, there are about as many cells as a cell has rows,
        ``MOST_CELLS`` at most. The centres are fitted on the driver to
        ``SAMPLE_ROWS`` vectors; all rows are indexed.
        """
        held = self._sound(rows)
        n = held.count()
        cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
        sample = held.orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
        centres = spherical_centres(unit(sample), cells) if n else np.empty((0, self.dim))
        named = f"centres/{uuid.uuid4().hex}"
        made = self.parts.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        made.coalesce(1).write.parquet(f"{self.parts.path}/{named}")
        empty = [Part(k, None, 0, stats=json.dumps({"least": 1.0, "centres": named})) for k in range(len(centres))]
        self._commit(self.parts.newest()[0], empty, set(range(len(empty))), self._dealt(held, centres), centres)

    def upsert(self, rows: DataFrame) -> int:
        """``rows`` in place of those with their ids; the cells that had one of them or get one are written anew: how many.

        Centres stay as they are; a cell's radius follows what is in it. A row
        whose vector is unfit is taken out of the index.
        """
        version, parts = self.parts.newest()
        if not parts:
            raise ValueError("the index has no cells; build it first")
        centres = self._centres(parts)
        fresh = self._dealt(self._sound(rows), centres).persist()
        ids = rows.select("row").distinct()
        try:
            had = self._placed(parts).join(ids, "row", "left_semi").select(PART)
            hit = {r[0] for r in had.union(fresh.select(PART)).distinct().collect()}
            if hit:
                kept = self._placed([p for k, p in enumerate(parts) if k in hit]).join(ids, "row", "left_anti")
                self._commit(version, parts, hit, kept.unionByName(fresh), centres)
        finally:
            fresh.unpersist()
        return len(hit)

    def search(self, queries: DataFrame, k: int, cells: int | None = None, where: Column | None = None) -> DataFrame:
        """``query, score, row``: for each of ``queries`` (``query, v``) its ``k`` nearest rows by cosine, equal scores by ``row``.

        A query asks first the nearest cells that have ``k`` rows, then all
        others whose bound reaches its ``k``-th score: with ``where``, which
        rows must meet, as without. ``cells``: it asks so many nearest cells
        and no others, and may miss rows.
        """
        _, parts = self.parts.newest()
        spark, kind = queries.sparkSession, queries.schema["query"].dataType.simpleString()
        asked = queries.where(sound(F.col("v"), self.dim)).select("query", F.col("v").cast("array<double>").alias("v"))
        if not any(p.folder for p in parts):
            return spark.createDataFrame([], f"query {kind}, score double, row {self.kind}")
        centres, sizes = self._centres(parts), np.array([p.rows for p in parts])
        least = np.array([json.loads(p.stats)["least"] for p in parts])
        routed = f"query {kind}, v array<double>, cell int"

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    order = [c for c in np.argsort(-(centres @ unit([row["v"]])[0]), kind="stable") if sizes[c]]
                    n = cells or 1 + int(np.searchsorted(np.cumsum(sizes[order]), k))
                    yield pd.DataFrame({"query": row["query"], "v": [row["v"]] * len(order[:n]), "cell": order[:n]})

        def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    cosines = centres @ unit([row["v"]])[0]
                    order = [c for c in np.argsort(-cosines, kind="stable") if sizes[c]]
                    n = 1 + int(np.searchsorted(np.cumsum(sizes[order]), k))
                    most = bounds(cosines, least)
                    more = [c for c in order[n:] if most[c] >= row["least"]]
                    if more:
                        yield pd.DataFrame({"query": row["query"], "v": [row["v"]] * len(more), "cell": more})

        found = self._compared(parts, asked.mapInPandas(first, routed), k, where, f"query {kind}, row {self.kind}, score double")
        if cells is None:
            found = written(found, scratch(spark, "found"))
            last = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
            open_ = asked.join(last, "query", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
            more = self._compared(parts, open_.mapInPandas(rest, routed), k, where, f"query {kind}, row {self.kind}, score double")
            found = _best(found.unionByName(more), k)
        return found

    def _compared(self, parts: list[Part], routed: DataFrame, k: int, where: Column | None, schema: str) -> DataFrame:
        """The ``k`` best rows of each query within the cells that it is routed to; only those cells' folders are read."""
        spark = routed.sparkSession
        routed = written(routed, scratch(spark, "routed"))
        counts = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each cell at most
        slices = lambda n: -(-n // BLOCK)
        cut = spark.createDataFrame([(c, slices(n), slices(parts[c].rows)) for c, n in counts.items()], "cell int, qs int, rs int")
        rows = self._placed([p for c, p in enumerate(parts) if c in counts])
        rows = (rows.where(where) if where is not None else rows).select(F.col(PART).alias("cell"), "row", "v")
        cell = F.broadcast(cut)  # MOST_CELLS rows at most
        own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = routed.join(cell, "cell").select("cell", "query", "v", own("query", "qs").alias("q"), each("rs").alias("r"))
        right = rows.join(cell, "cell").select("cell", "row", "v", own("row", "rs").alias("r"), each("qs").alias("q"))
        key = ["cell", F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r")]
        run: Callable = best_of_block(k)
        met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: run(a, b), schema)
        return _best(met, k)

    def _sound(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.parts.schema.names if c not in ("row", "v")]
        return rows.where(sound(F.col("v"), self.dim)).select("row", F.col("v").cast("array<double>").alias("v"), *rest)

    def _dealt(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """``rows`` with the cell of each."""

        def own(vectors: pd.Series) -> pd.Series:
            return pd.Series(nearest(unit(vectors), centres)[0] if len(vectors) else [], dtype="int32")

        return rows.withColumn(PART, F.pandas_udf(own, "int")("v"))

    def _centres(self, parts: list[Part]) -> np.ndarray:
        named = json.loads(parts[0].stats)["centres"]
        made = self.parts.spark.read.schema("cell int, centre array<double>").parquet(f"{self.parts.path}/{named}")
        return np.array([r.centre for r in made.orderBy("cell").collect()])  # MOST_CELLS at most

    def _placed(self, parts: list[Part]) -> DataFrame:
        """The rows of some parts with their cells; parts of one folder are read at once."""
        out = self.parts.spark.createDataFrame([], self.parts.schema).withColumn(PART, F.lit(0))
        for folder in dict.fromkeys(p.folder for p in parts if p.folder):
            out = out.unionByName(self.parts.written(folder).where(F.col(PART).isin([p.part for p in parts if p.folder == folder])))
        return out

    def _commit(self, version: int, parts: list[Part], hit: set[int], rows: DataFrame, centres: np.ndarray) -> None:
        """Writes the cells that were hit with ``rows``, looks how far they reach, and makes it a version."""
        folder = self.parts.write(rows, "row")

        def near(vectors: pd.Series, cell: pd.Series) -> pd.Series:
            return pd.Series((unit(vectors) * centres[cell.to_numpy()]).sum(axis=1) if len(vectors) else [], dtype="float64")

        there = self.parts.written(folder).select(PART, F.pandas_udf(near, "double")("v", PART).alias("near"))
        there = there.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least"))
        found = {r[PART]: (r.n, r.least) for r in there.collect()}
        named = json.loads(parts[0].stats)["centres"] if parts else ""
        made = [
            Part(k, folder if k in found else None, found.get(k, (0, 1.0))[0], stats=json.dumps({"least": found.get(k, (0, 1.0))[1], "centres": named}))
            if k in hit
            else p
            for k, p in enumerate(parts)
        ]
        self.parts.commit(version + 1, made)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "score", "row")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``recall``, the share of the rows of ``exact`` (``query, row``) that ``found`` has, and ``n``, how many there are."""
    hit = exact.join(found.select("query", "row", F.lit(1).alias("_hit")).distinct(), ["query", "row"], "left")
    return hit.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("n"))
