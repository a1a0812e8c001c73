"""Even sharding by sampled splitters."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import save

OVERHEAD = 16  # bytes that a row counts beside its text
KEY = ["class", "key", "tie"]
LEAST = -(1 << 63)


def _sortable(columns) -> np.ndarray:
    """Byte strings of three signed 64-bit numbers, ordered as the triples are."""
    held = np.stack([np.asarray(c, np.int64) for c in columns], axis=1)
    flipped = held.view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S24").ravel()


def _splitters(rows: DataFrame, total: int, ranges: int, sample: int, seed: int, hot: set[int]) -> set[tuple[int, ...]]:
    """Up to ``ranges - 1`` quantiles of a sample in which a row's chance grows with its size; only hot keys are cut within."""
    drawn = rows.where(F.rand(seed) < F.col("size") * F.lit(sample / total)).select(*KEY).toPandas().sort_values(KEY)
    if not len(drawn) or ranges < 2:
        return set()
    at = np.unique((np.arange(1, ranges) * len(drawn)) // ranges)
    return {(c, k, t if k in hot else LEAST) for c, k, t in drawn.iloc[at].to_numpy().tolist()}


def _ranged(rows: DataFrame, cuts: list[tuple[int, ...]]) -> DataFrame:
    edges = _sortable(zip(*cuts)) if cuts else np.empty(0, "S24")

    @F.pandas_udf(T.IntegerType())
    def place(kind: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _sortable([kind, key, tie]), side="right").astype(np.int32))

    return rows.withColumn("range", place(*KEY))


def _room(held: list[int], rest: int) -> list[int]:
    """How many of ``rest`` bytes each shard takes so that all end up at one level, as far as what they hold allows."""
    level, order = 0, sorted(held)
    for n in range(len(order), 0, -1):
        level = (rest + sum(order[:n])) / n
        if level >= order[n - 1]:
            break
    return [max(0, round(level - h)) for h in held]


def _passed(edges: list[int], value) -> F.Column:
    """How many of the rising ``edges`` lie at or below ``value``."""
    return F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 4,
    rows_per_range: int = 2_000_000,
    sample: int = 20_000,
) -> DataFrame:
    """Deal all rows out to ``shards`` shards of nearly equal bytes, groups of equal texts kept whole.

    Returns ``id_col, size, text_crc32, shard, slot``. A row's size is its
    UTF-8 bytes plus 16. Rows of equal text are one unit, which no shard border
    cuts; groups of over a quarter of a shard (at most four a shard, so their
    keys fit on the driver) are hot, and there each row is a unit. A unit's
    class is the power of two below its bytes. The key is the class, a hash of
    the text and one of the id, whose low bits are a count, so that rows that
    are alike in all have different keys too. About ``sample`` keys, drawn by
    size, come to the driver; their quantiles, and the borders of the classes,
    cut the key space into ranges, several per shard. A range of over twice
    its share is cut again from a denser sample until none is left that can be
    cut. Within a range, windows sum sizes in key order; with the exact totals
    of the ranges before it, each unit knows the byte of its class at its middle.

    The classes are dealt from the largest units to the smallest, all by one
    rule: a class's stretch of the key order is cut where each shard's room
    ends, that is, what it lacks to the level that all can reach; what a shard
    has really got is counted before the next class. So what a large unit makes
    uneven the next smaller ones level, and shards differ by about the size of
    the smallest units, unless a few rows are larger than a share. A class is
    one small job on saved sizes; there are as many as powers of two.

    Null texts count 16 bytes and are equal to empty ones; null and repeated
    ids are dealt like others, in any order among rows that are alike. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(text_col, F.lit(""))
    count = F.monotonically_increasing_id().bitwiseAND(F.lit(4095).cast("long"))
    rows = save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(-4096).cast("long")).bitwiseOR(count).alias("tie"),
        ),
        "sizes",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = {r["key"] for r in groups.where((F.col("n") > 1) & (F.col("bytes") > total / (4 * shards))).select("key").collect()}
    is_hot = F.col("key").isin(*hot) if hot else F.lit(False)
    alone = rows.where(is_hot).withColumn("unit", F.col("size"))
    whole = rows.where(~is_hot).withColumn("unit", F.sum("size").over(Window.partitionBy("key")))
    rows = save(alone.unionByName(whole).withColumn("class", (F.length(F.bin("unit")) - 1).cast("long")), "units")
    classes = {r["class"]: r for r in rows.groupBy("class").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    ranges = max(ranges_per_shard * shards, -(-sum(r["n"] for r in classes.values()) // rows_per_range))
    share = max(1, total / ranges)
    cuts = {(c, LEAST, LEAST) for c in classes}
    if total:
        cuts |= _splitters(rows, total, ranges, max(sample, 50 * ranges), 1, hot)
    for turn in itertools.count():
        placed = _ranged(rows, sorted(cuts))
        sums = placed.groupBy("range").agg(F.min("class").alias("class"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas()
        full = sums[(sums["bytes"] > 2 * share) & (sums["n"] > 1)]
        if full.empty:
            break
        held = placed.where(F.col("range").isin(full["range"].tolist()))
        weight = int(full["bytes"].sum())
        parts = int(weight // share) + 1
        more = _splitters(held, weight, 2 * parts, 200 * parts, 2 + turn, hot)
        if more <= cuts:  # what is left are rows larger than a share
            break
        cuts |= more
    sums = sums.sort_values("range")
    by_class = sums.groupby("class")
    before = pd.DataFrame(
        {
            "range": sums["range"].astype("int32"),
            "bytes_before": (by_class["bytes"].cumsum() - sums["bytes"]).astype("int64"),
            "rows_before": (by_class["n"].cumsum() - sums["n"]).astype("int64"),
        }
    )
    starts = spark.createDataFrame(before, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("key", "tie", "id", "size", "text_crc32")
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = Window.partitionBy("range").orderBy("key")  # its frame ends with the last row of the same key
    # one row per range: their number is set above and does not follow the rows' width
    places = placed.join(F.broadcast(starts), "range").select(
        "id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("rank"),
        (2 * (F.col("bytes_before") + F.when(is_hot, F.sum("size").over(here)).otherwise(F.sum("size").over(units))) - F.col("unit")).alias("middle"),
        "class",
    )
    places = save(places, "places", by="class")

    bytes_held, rows_held, plan = [0] * shards, [0] * shards, []
    for c in sorted(classes, reverse=True):
        edges = (2 * np.cumsum(np.array(_room(bytes_held, classes[c]["bytes"]), np.int64))[:-1]).tolist()
        own = places.where(F.col("class") == c).groupBy(_passed(edges, F.col("middle")).alias("shard"))
        got = {r["shard"]: r for r in own.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        taken = [got[s]["n"] if s in got else 0 for s in range(shards)]
        first = np.cumsum([0, *taken])[:-1]
        # a row's slot is its rank less the first rank of its shard in the class, after the rows of larger classes there
        plan.append((c, first[1:].tolist(), [int(held - f) for held, f in zip(rows_held, first)]))
        for s in range(shards):
            bytes_held[s] += got[s]["bytes"] if s in got else 0
            rows_held[s] += taken[s]
    told = spark.createDataFrame(plan, "class long, edges array<long>, shift array<long>")  # a row per power of two
    dealt = places.join(F.broadcast(told), "class").withColumn("shard", F.size(F.filter("edges", lambda e: e <= F.col("rank"))))
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") + F.get("shift", F.col("shard"))).alias("slot")
    )
