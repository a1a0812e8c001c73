"""Near-duplicate vectors found cell by cell after spherical k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, save

SLACK = 1e-6  # radians added to each bound, for rounding


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` unit centres of the unit rows of ``x``; an empty cell takes over a row that is far from its own centre."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        bad = size < 1e-12
        sums[bad] = x[np.argsort(best, kind="stable")[: int(bad.sum())]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x, np.sqrt((x * x).sum(axis=1))


class _Forest:
    """Components of numbered nodes, each named by its least node."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in {(min(x), max(x)) for x in zip(self.up[a].tolist(), self.up[b].tolist()) if x[0] != x[1]}:
            i, j = self._top(i), self._top(j)
            self.up[max(i, j)] = min(i, j)
        while (flat := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = flat

    def _top(self, i: int) -> int:
        while self.up[i] != i:
            i = int(self.up[i])
        return i

    def link(self, hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Joins the nodes of rows and columns wherever ``hit`` is set.

        Each row joins the least component among its columns and each column
        that among its rows, until a row has one component in all its columns;
        so no list of pairs is made, however dense the matrix.
        """
        some = hit.any(axis=1)
        hit, rows = hit[some], rows[some]
        none = len(self.up)
        while len(rows):
            at = np.where(hit, self.up[columns].astype(np.int32)[None, :], np.int32(none))
            least = at.min(axis=1)
            split = ((at != least[:, None]) & hit).any(axis=1) | (self.up[rows] != least)
            hit, rows, least = hit[split], rows[split], least[split]
            if not len(rows):
                break
            self.join(rows, least)
            at = np.where(hit, self.up[rows].astype(np.int32)[:, None], np.int32(none)).min(axis=0)
            met = at < none
            self.join(columns[met], at[met])


def _compare(threshold: float, tile: int):
    """For one pair of blocks: links by row, and a spanning forest of them rather than all pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = bool(pdf["same"].iloc[0])
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "peer": [], "links": []}).astype("int64")
        a, na = _unit(left["v"])
        b, nb = _unit(right["v"])
        node_a, node_b = left["node"].to_numpy(), right["node"].to_numpy()
        copies_a, copies_b = left["n"].to_numpy(), right["n"].to_numpy()
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        own_a = np.arange(len(a))
        own_b = own_a if same else len(a) + np.arange(len(b))
        forest = _Forest(len(a) if same else len(a) + len(b))
        for at in range(0, len(a), tile):
            s = slice(at, at + tile)
            cos = (a[s] @ b.T) / (na[s, None] * nb[None, :])
            hit = cos >= threshold
            if same:
                hit[np.arange(hit.shape[0]), at + np.arange(hit.shape[0])] = False
            links_a[s] += hit @ copies_b
            if not same:
                links_b += copies_a[s] @ hit
            forest.link(hit, own_a[s], own_b)
        if same:
            return pd.DataFrame({"node": node_a, "peer": node_a[forest.up], "links": links_a})
        nodes = np.concatenate([node_a, node_b])
        return pd.DataFrame({"node": nodes, "peer": nodes[forest.up], "links": np.concatenate([links_a, links_b])})

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    cell_rows: int = 8_192,
    sample_rows: int = 20_000,
    block_rows: int = 8_192,
) -> DataFrame:
    """Per row: ``id_col, n_links, component_id, kept``; links join vectors of one label at cosine ``threshold`` or more.

    Equal vectors of a label become one row with its number of copies. Per
    label, spherical k-means on at most ``sample_rows`` vectors in all gives
    cells of about ``cell_rows``; every vector goes to its nearest centre. It
    also visits each later cell that may hold a link of it, by two bounds that
    lose none: the cell's radius plus the angle of ``threshold`` reaches it, and
    the plane halfway between the two centres is no further from it than that
    angle. Where vectors have clusters, few cells pass; where they have none,
    as random ones in many dimensions, all do, and the work is that of all
    pairs of a label, as it is for any exact method. Blocks of about
    ``block_rows`` members of a cell meet one another and the cell's visitors,
    in chunks of as many, pair by pair as groups of their own, in tiled matrix
    products of doubles; they give counts of links and a spanning forest,
    never all pairs. A vector is sent once for each pair of blocks that it is
    in, so blocks are as large as a task's memory allows. A vector that is null
    or zero, has components that are null or not finite, or a null label links
    with nothing. Vectors of different lengths never link. Null ids count as
    rows, but name no component unless all its ids are null. No rows give no
    rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0.0),
        F.lit(False),
    ) & label.isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.when(sound, F.transform(v, lambda x: x + 0.0)).alias("v"))
    keyed = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    rows = save(keyed, "vectors")
    distinct = (
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("kind", F.concat_ws("/", "label", F.size("v").cast("string")))
    )
    distinct = save(distinct, "distinct-vectors")

    counts = distinct.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = distinct.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = distinct.where((F.xxhash64("key") % 1_000_003 + 1_000_003) % 1_000_003 < share * 1_000_003)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = _unit(pdf.sort_values("key")["v"])
        k = max(1, min(len(x), round(int(pdf["total"].iloc[0]) / cell_rows)))
        centres = spherical_kmeans(x / n[:, None], k)
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "centre": list(centres)})

    fits = drawn.join(counts.withColumnRenamed("n", "total"), "kind").select("kind", "key", "v", "total")
    centres = save(fits.groupBy("kind").applyInPandas(fitted, "kind string, centre array<double>"), "centres").toPandas()
    by_kind = {k: np.array(g["centre"].tolist()) for k, g in centres.groupby("kind")}
    sent = spark.sparkContext.broadcast(by_kind)  # at most sample_rows centres

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            home, angle = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.pi)
            for kind, at in pdf.groupby("kind").indices.items():
                c = sent.value.get(kind)
                if c is None:
                    continue
                x, n = _unit(pdf["v"].iloc[at])
                near = (x / n[:, None]) @ c.T
                home[at] = near.argmax(axis=1)
                angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pdf[["node", "n", "kind", "v"]].assign(home=home, angle=angle)

    placed = save(distinct.mapInPandas(homes, "node long, n long, kind string, v array<double>, home long, angle double"), "homes")
    cells = placed.groupBy("kind", "home").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
    cells = save(cells, "cells")
    # one row per cell: as many as there are centres at most
    radii = {k: g.set_index("home")["radius"] for k, g in cells.toPandas().groupby("kind")}
    told = spark.sparkContext.broadcast(radii)
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds the cells after its own that may hold links of a vector."""
        for pdf in batches:
            seen = np.empty(len(pdf), object)
            for kind, at in pdf.groupby("kind").indices.items():
                c, home = sent.value.get(kind), pdf["home"].to_numpy()[at]
                if c is None:
                    seen[at] = [[] for _ in at]
                    continue
                x, n = _unit(pdf["v"].iloc[at])
                near = (x / n[:, None]) @ c.T
                radius = np.full(len(c), -1.0)  # nobody visits a cell without members
                radius[told.value[kind].index] = told.value[kind] + reach
                # vectors nearest to another centre lie beyond the plane halfway to it
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-24))[home]
                plane = np.arcsin(np.clip((near[np.arange(len(at)), home][:, None] - near) / apart, 0, 1))
                goes = (np.arccos(np.clip(near, -1, 1)) <= radius) & (plane <= reach) & (np.arange(len(c)) > home[:, None])
                seen[at] = [np.flatnonzero(g).tolist() for g in goes]
            yield pdf[["node", "n", "kind", "v", "home"]].assign(seen=seen)

    seated = save(placed.mapInPandas(visits, "node long, n long, kind string, v array<double>, home long, seen array<long>"), "visits")
    guests = seated.select("kind", F.explode("seen").alias("home")).groupBy("kind", "home").agg(F.count(F.lit(1)).alias("guests"))
    sizes = cells.join(guests, ["kind", "home"], "left").select(
        "kind",
        F.col("home").alias("cell"),
        F.ceil(F.col("rows") / block_rows).alias("blocks"),
        F.ceil(F.coalesce("guests", F.lit(0)) / block_rows).alias("chunks"),
    )
    sizes = F.broadcast(save(sizes, "cell-sizes"))  # one row per cell
    columns = ["node", "n", "kind", "v", "cell", "block", "guests", "side", "same"]
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    visitors = seated.select("node", "n", "kind", "v", F.explode("seen").alias("cell")).join(sizes, ["kind", "cell"])
    visitors = visitors.withColumn("guests", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("block", up_to("blocks"))
    visitors = visitors.withColumns({"side": F.lit(0), "same": F.lit(False)})
    members = seated.withColumnRenamed("home", "cell").join(sizes, ["kind", "cell"]).withColumn("block", F.pmod("node", F.col("blocks")))
    hosts = members.where("chunks > 0").withColumn("guests", up_to("chunks")).withColumns({"side": F.lit(1), "same": F.lit(False)})
    # blocks meet one another as well: the lower number of a pair is kept as guests below zero
    within = members.withColumn("other", up_to("blocks")).withColumns(
        {
            "guests": -1 - F.least("block", "other"),
            "side": (F.col("block") > F.col("other")).cast("int"),
            "same": F.col("block") == F.col("other"),
            "block": F.greatest("block", "other"),
        }
    )
    pairs = visitors.select(columns).union(hosts.select(columns)).union(within.select(columns))
    compared = pairs.groupBy("kind", "cell", "guests", "block").applyInPandas(
        _compare(threshold, 256), "node long, peer long, links long"
    )
    compared = save(compared.where("links > 0 or node <> peer"), "links")
    joined = components(compared.where("node <> peer").select(F.col("node").alias("src"), F.col("peer").alias("dst")))
    linked = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = (
        distinct.select("key", "node", "n")
        .join(linked, "node", "left")
        .join(joined, "node", "left")
        .select("key", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    least = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least")).join(found, "key")
    least = least.groupBy("root").agg(F.min("least").alias("component_id"))
    found = save(found.join(least, "root").select("key", "n_links", "component_id"), "vector-groups")
    result = rows.select("id", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
