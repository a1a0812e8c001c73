"""Merkle manifest of a dataset: rows are leaves of a tree per group, the groups' roots are leaves of one tree.

By lag and lead windows, level by level: a node stands in the row of its first
leaf, so the nodes of a run lie at fixed offsets of each other. Lag and lead
columns, masked by the node's slot in its run and by the run's length, are its
siblings; the row of a first child hashes the parent. On the way back the same
offsets carry each parent's proof to its children.

A window never spans a group: it spans a block of ``fanout ** levels`` leaves,
and the tops of the blocks are the leaves of the next round, so no task holds
more than a block of any group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
LEVELS = 10  # of a block: 1,024 leaves at fanout 2
RANGE_ROWS = 200_000  # rows that are numbered in one task
NO_PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 bytes of the value as text, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the fields of the values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the siblings' digests, from the leaf's level to the top, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (saved, with ``g``) with ``slot``, from 0 within ``g`` by ``order``, and ``n``, the rows of ``g``.

    Rows go to ranges of (g, order); a range counts its rows, and the counts of
    the ranges before it in the group are added. Groups are cut where ranges end.
    """
    parts = max(1, math.ceil(rows.count() / RANGE_ROWS))
    ranged = save(rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("g")
    before = F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("g", "part", (before - F.col("here")).alias("before"), F.sum("here").over(group).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    placed = ranged.withColumn("place", place).join(counts, ["g", "part"])
    return placed.withColumn("slot", F.col("before") + F.col("place")).drop("part", "place", "before")


def _block_of(fanout: int, levels: int) -> Column:
    return F.floor(F.col("slot") / F.lit(fanout**levels)).cast("long")


def _climbed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (``g, slot, n, digest``) with ``block`` and, for each level, the digests ``h`` and siblings ``l`` and ``r`` in the rows of nodes."""
    block = Window.partitionBy("g", "block").orderBy("slot")
    rows = nodes.withColumns({"block": _block_of(fanout, levels), "h0": F.col("digest")})
    for level in range(levels):
        step, h = fanout**level, F.col(f"h{level}")
        digit = F.floor(F.col("slot") / step) % fanout
        several = F.col("n") > step
        left = F.concat_ws("", *[F.when(digit >= j, F.lag(h, j * step).over(block)) for j in range(fanout - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(digit < fanout - j, F.lead(h, j * step).over(block)) for j in range(1, fanout)])
        parent = F.when(several, F.sha2(F.concat(h, right), 256)).otherwise(h)
        node = (F.col("slot") % step == 0) & several
        rows = rows.withColumns(
            {
                f"l{level}": F.when(node, left),
                f"r{level}": F.when(node, right),
                f"h{level + 1}": F.when(F.col("slot") % (step * fanout) == 0, parent),
            }
        )
    return rows


def _descended(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Climbed rows with ``proof`` within their block and ``top``, its digest."""
    block = Window.partitionBy("g", "block").orderBy("slot")
    kept = [c for c in rows.columns if c not in {f"{x}{k}" for k in range(levels + 1) for x in "lrh"}]
    top = F.first(f"h{levels}").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("top")
    proof = F.array().cast(NO_PROOF)
    rows = rows.select(*kept, *[f"{x}{k}" for k in range(levels) for x in "lr"], top, proof.alias("proof"))
    for level in reversed(range(levels)):
        step = fanout**level
        digit = F.floor(F.col("slot") / step) % fanout
        above = F.when(digit == 0, F.col("proof"))
        for j in range(1, fanout):
            above = above.when(digit == j, F.lag("proof", j * step).over(block))
        own = F.when(F.col("n") > step, F.array(F.struct(F.col(f"l{level}").alias("left"), F.col(f"r{level}").alias("right"))))
        proof = F.when(F.col("slot") % step == 0, F.concat(F.coalesce(own, F.array().cast(NO_PROOF)), above))
        rows = rows.select(*kept, *[f"{x}{k}" for k in range(level) for x in "lr"], "top", proof.alias("proof"))
    return rows


def _proven(nodes: DataFrame, most: int, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (saved; ``g, slot, n, digest``; no group has over ``most``) with ``proof`` and ``top``, the root of their group."""
    while levels > 1 and fanout ** (levels - 1) >= most:
        levels -= 1
    climbed = _climbed(nodes, fanout, levels)
    rows = _descended(climbed, fanout, levels)
    span = fanout**levels
    if most <= span:
        return rows.drop("block")
    tops = climbed.where(F.col("slot") % span == 0).select(
        "g", F.col("block").alias("slot"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col(f"h{levels}").alias("digest")
    )
    upper = _proven(save(tops, "tops"), math.ceil(most / span), fanout, levels)
    upper = upper.select("g", F.col("slot").alias("block"), F.col("proof").alias("higher"), F.col("top").alias("highest"))
    joined = rows.join(upper, ["g", "block"])
    return joined.withColumns({"proof": F.concat("proof", "higher"), "top": F.col("highest")}).drop("block", "higher", "highest")


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    keep: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """``order, leaf, slot, n_leaves, subroot, root, proof`` and the columns of ``keep``: one row for each row of ``docs``.

    A leaf is the digest of the fields of ``columns``. The leaves of a
    ``group`` ascend by ``order`` (integers or strings; nulls first); every
    ``fanout`` consecutive nodes become their digest, the last run of a level
    may be shorter, until one node is left, the subroot; a lone leaf is one
    itself. The subroots, by group (null first, then by bytes), give the root
    in the same way. ``proof`` lists for each level up to the root the digests
    ``left`` and ``right`` of the node in its run, empty texts where there are
    none. ``folded`` gives the root again.

    Nulls are values: a null group is a group. Rows with equal ``order`` go by
    their leaves, so equal rows may change places and nothing else changes; an
    empty table has no rows. Texts of any length are hashed where they lie.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    carried = keep or {}
    clash = {"leaf", "slot", "n_leaves", "subroot", "root", "proof"} & {order, *carried}
    if clash:
        raise ValueError(f"names of results are taken: {sorted(clash)}")
    named = {c: F.col(f"`{c}`") for c in {*columns, group, order}}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), named[group].cast("string")), F.lit("-")).alias("g"),  # sorts as the group does, null first
        named[order].alias("id"),
        leaf(*[named[c] for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carried.items()]).alias("kept"),
    )
    nodes = save(_numbered(save(leaves, "leaves"), ["id", "digest", "tie"]).drop("tie"), "numbered")
    most = nodes.agg(F.max("n")).first()[0] or 0
    rows = _proven(nodes, most, fanout, levels)

    subroots = save(rows.where("slot = 0").select("g", F.col("top").alias("digest")), "subroots")
    upper = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), ["of"])
    upper = _proven(save(upper, "roots"), subroots.count(), fanout, levels)
    upper = save(upper.select(F.col("of").alias("g"), F.col("proof").alias("last"), F.col("top").alias("root")), "root")
    found = rows.join(upper, "g")  # as many rows as groups: the optimizer sees its size
    return found.select(
        F.col("id").alias(order),
        F.col("digest").alias("leaf"),
        "slot",
        F.col("n").alias("n_leaves"),
        F.col("top").alias("subroot"),
        "root",
        F.concat("proof", "last").alias("proof"),
        *[F.col(f"kept.`{k}`").alias(k) for k in carried],
    )
