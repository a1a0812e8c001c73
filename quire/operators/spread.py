"""Ordered work on groups that are larger than a task: numbers, islands and greedy parts by ranges.

Rows go to ranges of (group, order), which cut groups wherever they end. Within
a range a window does the work; the little that one range has to know of those
before it is added up over a table with a row for each group and range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import scenes
from quire.sources.tables import scratch, written

RANGE_ROWS = 200_000
BLOCK = 8192  # items of a block in greedy packing
FAN = 256  # blocks whose functions are composed at a time


def ranged(rows: DataFrame, group: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` written out with ``_range``: ascending numbers of ranges of (group, order), about ``range_rows`` rows each.

    Rows with equal group and order are in one range; a null group is a group.
    """
    parts = max(1, -(-rows.count() // range_rows))
    # the number of a task's range is its number among the tasks of the range exchange
    dealt = rows.repartitionByRange(parts, group, order).withColumn("_range", F.spark_partition_id())
    return written(dealt, scratch(rows.sparkSession, "ranges"))


def _key(group: str) -> Column:
    """A group as a value that is equal to itself even where it is null."""
    return F.struct(F.col(group).alias("g"))


def _before(sums: DataFrame, *values: str) -> DataFrame:
    """``_g, _range`` and, for each of ``values``, its sum over the group's earlier ranges."""
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_g", "_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values])


def numbered(rows: DataFrame, group: str, order: str, name: str = "number", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: from 0 within the group, by ``order``, which is unique there."""
    cut = ranged(rows, group, order, range_rows).withColumn("_g", _key(group))
    before = _before(cut.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_had")), "_had")
    place = F.row_number().over(Window.partitionBy("_g", "_range").orderBy(order))
    found = cut.withColumn("_place", place).join(before, ["_g", "_range"])
    return found.withColumn(name, F.col("_had") + F.col("_place") - 1).drop("_g", "_range", "_had", "_place")


def islands(rows: DataFrame, group: str, order: str, opens: Column, ends: Column, name: str = "_group", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``, the number of the island they are in, from 1 within the group.

    A row joins the one before it where it ``opens`` and that one ``ends``
    (nulls: no). The last row of a range is handed to the next range of the
    group, so an island may run over any number of ranges.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    cut = ranged(rows.withColumns({"_opens": yes(opens), "_ends": yes(ends)}), group, order, range_rows).withColumn("_g", _key(group))
    last = cut.groupBy("_g", "_range").agg(F.max_by("_ends", order).alias("_ends"))
    handed = F.lag("_ends").over(Window.partitionBy("_g").orderBy("_range"))
    last = last.select("_g", "_range", yes(handed).alias("_handed"))
    within = Window.partitionBy("_g", "_range").orderBy(order)
    flagged = cut.join(last, ["_g", "_range"])
    first = ~(F.col("_opens") & F.coalesce(F.lag("_ends").over(within), F.col("_handed")))
    flagged = flagged.withColumn("_first", first.cast("long"))
    running = F.sum("_first").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = written(flagged.withColumn("_running", running).drop("_g"), scratch(rows.sparkSession, "islands")).withColumn("_g", _key(group))
    before = _before(flagged.groupBy("_g", "_range").agg(F.sum("_first").alias("_had")), "_had")
    found = flagged.join(before, ["_g", "_range"]).withColumn(name, F.col("_had") + F.col("_running"))
    return found.drop("_g", "_range", "_opens", "_ends", "_handed", "_first", "_running", "_had")


def stitched(labels: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scenes.stitched`` for books of any size: no task holds more than a range of a book.

    Islands are numbered without gaps, so their number is that of the scene.
    """
    grouped = islands(labels, "book_id", "ord", F.col("open_start_index"), F.col("open_end_index"), "_group", range_rows)
    return scenes.joined(grouped).withColumn("scene", F.col("_group") - 1).select(*scenes.STITCHED)


def linked(scenes_: DataFrame) -> DataFrame:
    """``scenes.linked`` for numbers without gaps: ids follow from the numbers, so no book is sorted."""
    counts = scenes_.groupBy(_key("book_id").alias("_g")).agg((F.max("scene") + 1).alias("_n"))
    named = lambda n: F.concat_ws("-", "book_id", n.cast("string"))
    number, rows = F.col("scene"), scenes_.withColumn("_g", _key("book_id")).join(counts, "_g")
    return rows.withColumns(
        {
            "scene_id": named(number),
            "prev_scene_id": F.when(number > 0, named(number - 1)),
            "next_scene_id": F.when(number < F.col("_n") - 1, named(number + 1)),
        }
    ).drop("_g", "_n")


# -- greedy parts: what a block does to an open part is a step function of its size; functions of blocks are composed


def _chain(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums from 0, for each item the one that begins the next part if it begins one itself)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return total, np.maximum(after, np.arange(len(sizes)) + 1)


def transition(sizes: np.ndarray, limit: int) -> np.ndarray:
    """What a block of items does to the part that is open before it: rows (size from which it holds, size after the block, parts begun).

    A size above ``limit`` stands for a part that takes nothing more, and for
    none at all. Rows ascend, and each holds up to the next one. Where no part
    is begun, the size after the block is what is added. There are no more
    rows than items fit in a part, whatever the block has.
    """
    n = len(sizes)
    total, after = _chain(sizes, limit)
    full, begun = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        full[i], begun[i] = (total[n] - total[i], 1) if j >= n else (full[j], begun[j] + 1)
    rows = []
    for i in range(n):  # the first item that does not fit begins a part
        least = max(0, limit - int(total[i + 1]) + 1)
        if not rows or least < rows[-1][0]:
            rows.append((least, min(int(full[i]), limit + 1), int(begun[i])))
        if least == 0:
            break
    else:
        rows.append((0, int(total[n]), 0))
    return np.array(rows[::-1], np.int64)


def applied(function: np.ndarray, size: int, limit: int) -> tuple[int, int]:
    """(size of the open part, parts begun) after a block that is entered with ``size``."""
    _, out, begun = function[np.searchsorted(function[:, 0], min(size, limit + 1), side="right") - 1]
    return (int(out), int(begun)) if begun else (size + int(out), 0)


def composed(first: np.ndarray, second: np.ndarray, limit: int) -> np.ndarray:
    """The function of two blocks, one after the other."""
    rows = []
    for k, (least, out, begun) in enumerate(first):
        if begun:
            size, more = applied(second, int(out), limit)
            rows.append((least, size, begun + more))
            continue
        upto = first[k + 1][0] if k + 1 < len(first) else limit + 2
        for j, (bound, then, more) in enumerate(second):  # sizes grow by ``out`` and meet the steps of the second
            start = max(least, bound - out)
            end = second[j + 1][0] - out if j + 1 < len(second) else upto
            if start < min(end, upto):
                rows.append((start, then if more else out + then, more))
    return np.array(rows, np.int64)


def _sorted(frame: pd.DataFrame, *by: str) -> pd.DataFrame:
    return frame.sort_values(list(by), kind="stable")


def _functions(limit: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        made = transition(_sorted(block, "_place")["_size"].to_numpy(np.int64), limit)
        return pd.DataFrame({"_g": [key[0]], "_range": [key[1]], "_block": [key[2]], "f": [made.ravel().tolist()]})

    return run


def _composed(limit: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        made = None
        for f in _sorted(nodes, "seq")["f"]:
            f = np.asarray(f, np.int64).reshape(-1, 3)
            made = f if made is None else composed(made, f, limit)
        return pd.DataFrame({"_g": [key[0]], "seq": [key[1]], "f": [made.ravel().tolist()]})

    return run


def _entered(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """With what size, and after how many parts, each node of a family is entered; ``size`` and ``parts`` are those of the first."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = _sorted(nodes, "seq")
        size, parts, out = int(nodes["size"].iloc[0]), int(nodes["parts"].iloc[0]), []
        for f in nodes["f"]:
            out.append((size, parts))
            size, begun = applied(np.asarray(f, np.int64).reshape(-1, 3), size, limit)
            parts += begun
        made = pd.DataFrame(out, columns=["size", "parts"])
        return pd.DataFrame({"_g": nodes["_g"].to_numpy(), "seq": nodes["seq"].to_numpy(), "size": made["size"], "parts": made["parts"]})

    return run


def _dealt(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The parts of a block's items."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = _sorted(block, "_place")
        sizes, size = block["_size"].to_numpy(np.int64), int(block["size"].iloc[0])
        total, after = _chain(sizes, limit)
        first = int(np.searchsorted(total[1:], limit - size, side="right")) if size <= limit else 0
        begins = np.zeros(len(sizes), np.int64)
        while first < len(sizes):
            begins[first] = 1
            first = int(after[first])
        return block[["_g", "_range", "_place"]].assign(part=int(block["parts"].iloc[0]) + np.cumsum(begins))

    return run


def packed(items: DataFrame, group: str, order: str, size: Column, limit: int, range_rows: int = RANGE_ROWS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``group, order, part, part_count``: ``paragraphs.packed`` for groups of any size; ``order`` is unique in its group.

    Each block of ``block`` items gives the step function of what it does to
    the open part; ``fan`` functions at a time are composed, level by level,
    until a group has no more than that. From there the sizes that blocks are
    entered with go down again, and each block deals out its items. Sizes are
    not below 0. No task holds more than a range, a block or ``fan`` functions.
    """
    spark = items.sparkSession
    cut = ranged(items.select(group, order, size.cast("long").alias("_size")), group, order, range_rows)
    cut = cut.withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")))
    place = F.row_number().over(Window.partitionBy("_g", "_range").orderBy(order)) - 1
    cut = cut.withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / block))
    cut = written(cut, scratch(spark, "placed"))
    blocks = cut.select("_g", "_range", "_block", "_place", "_size").groupBy("_g", "_range", "_block")
    blocks = written(blocks.applyInPandas(_functions(limit), "_g string, _range int, _block long, f array<long>"), scratch(spark, "blocks"))
    # a row for each block, not for each item
    seq = F.row_number().over(Window.partitionBy("_g").orderBy("_range", "_block")) - 1
    levels = [written(blocks.withColumn("seq", seq.cast("long")), scratch(spark, "functions"))]
    most = (levels[0].agg(F.max("seq")).first()[0] or 0) + 1
    family = F.floor(F.col("seq") / fan)
    while most > fan:
        families = levels[-1].select("_g", "seq", "f", family.alias("of")).groupBy("_g", "of")
        levels.append(written(families.applyInPandas(_composed(limit), "_g string, seq long, f array<long>"), scratch(spark, "functions")))
        most = -(-most // fan)
    outside = spark.createDataFrame([], "_g string, of long, size long, parts long")
    for level in reversed(levels):
        nodes = level.select("_g", "seq", "f", family.alias("of")).join(outside, ["_g", "of"], "left")
        nodes = nodes.withColumns({"size": F.coalesce("size", F.lit(limit + 1)), "parts": F.coalesce("parts", F.lit(0))})
        entries = nodes.groupBy("_g", "of").applyInPandas(_entered(limit), "_g string, seq long, size long, parts long")
        entries = written(entries, scratch(spark, "entries"))
        outside = entries.withColumnRenamed("seq", "of")
    entered = levels[0].join(entries, ["_g", "seq"]).select("_g", "_range", "_block", "size", "parts")
    ready = cut.select("_g", "_range", "_block", "_place", "_size").join(entered, ["_g", "_range", "_block"])
    dealt = ready.groupBy("_g", "_range", "_block").applyInPandas(_dealt(limit), "_g string, _range int, _place int, part long")
    dealt = written(dealt, scratch(spark, "dealt"))
    counts = dealt.groupBy("_g").agg(F.max("part").alias("part_count"))
    found = cut.drop("_block", "_size").join(dealt, ["_g", "_range", "_place"]).join(counts, "_g")
    return found.select(group, order, "part", "part_count")
