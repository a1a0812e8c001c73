"""The scene table laid out for lookups: buckets by id, and ranges of (book, place) with statistics.

``get`` reads one bucket, ``neighbors`` the ranges that a book's places lie in,
``find`` the ranges whose statistics leave room for the filters.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.vocabulary import FILTERS
from quire.operators import relational
from quire.sources.parts import PART, ROWS_PER_PART, Part, RangedTable

ROWS_PER_BUCKET = 500_000
MOST_BUCKETS = 4096
#: Columns with few values: each range lists those that it has. Of the other filters it knows the least and the greatest.
LISTED = ["dominant_tone", "prev_tone", "next_tone", "intensity", "arc", "stitch_status"]
SPANNED = [c for c in FILTERS if c not in (*LISTED, "enriched")]


class SceneTable:
    """Scene rows (``scene_id, book_id, pos`` and others, one row for each id) under ``path``; each ``build`` is a new version of both copies."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, rows_per_part: int = ROWS_PER_PART):
        self.spark = spark
        self.places = RangedTable(spark, path, schema, ["book_id", "pos"], ["scene_id"], rows_per_part)

    def build(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Lays out ``rows`` in place of what was there; until both copies are whole, readers keep to the version before."""
        rows = rows.select(*self.places.schema.names)
        n = rows.count()
        buckets = buckets or max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
        by_id = f"by-id/{uuid.uuid4().hex}"
        writer = rows.repartition(buckets, "scene_id").write.bucketBy(buckets, "scene_id").sortBy("scene_id")
        writer.option("path", f"{self.places.path}/{by_id}").saveAsTable(self._name(by_id))
        lows: list[str | None] = [None]
        if n > self.places.rows_per_part:
            lows += self.places._cut(rows, lows, {0: n}, max(self.places.rows_per_part, n // 4096))[0]
        folder = self.places.write(rows.withColumn(PART, self.places.place(lows)), "book_id", "pos", bloom=["scene_id"])
        known = {"buckets": buckets, "by_id": by_id}
        stats = {r[PART]: r for r in self._stats(folder).collect()}  # a row for each range
        parts = [
            Part(p, folder if p in stats else None, stats[p].n if p in stats else 0, low, json.dumps(known | (json.loads(stats[p].known) if p in stats else {})))
            for p, low in enumerate(lows)
        ]
        self.places.commit(self.places.newest()[0] + 1, parts)

    def _stats(self, folder: str) -> DataFrame:
        here = [c for c in FILTERS if c in self.places.schema.names]
        listed = [F.collect_set(c).alias(c) for c in LISTED if c in here]
        spans = [F.array(F.min(c), F.max(c)).alias(c) for c in SPANNED if c in here]
        rows = self.places.written(folder).groupBy(PART)
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.struct(*listed).alias("listed"), F.struct(*spans).alias("spans"))
        return found.select(PART, "n", F.to_json(F.struct("listed", "spans")).alias("known"))

    def _name(self, by_id: str) -> str:
        return "scenes_" + by_id.rpartition("/")[2]

    def by_id(self) -> DataFrame:
        """The copy in buckets. A session that has not seen it yet enters it in its catalog."""
        parts = self.places.newest()[1]
        if not parts:
            return self.spark.createDataFrame([], self.places.schema)
        known = json.loads(parts[0].stats)
        name = self._name(known["by_id"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.places.schema)
            self.spark.sql(
                f"create table if not exists {name} ({columns}) using parquet clustered by (scene_id) sorted by (scene_id) "
                f"into {known['buckets']} buckets location '{self.places.path}/{known['by_id']}'"
            )
        return self.spark.table(name)

    def by_place(self) -> DataFrame:
        """The copy in ranges, whole."""
        return self.places.table()

    def get(self, scene_id: str) -> DataFrame:
        return relational.get(self.by_id(), scene_id)

    def get_each(self, ids: DataFrame) -> DataFrame:
        """The rows of ``ids`` (``scene_id``, each once); only ``ids`` are dealt out, the buckets lie as they are."""
        return self.by_id().join(ids.select("scene_id"), "scene_id", "left_semi")

    def neighbors(self, scene_id: str, before: int = 1, after: int = 1) -> DataFrame:
        """The scene and those around it in its book, in order; nothing for an unknown id or a scene without a place."""
        at = self.get(scene_id).select("book_id", "pos").first()
        if at is None or at.book_id is None or at.pos is None:
            return self.places.read([])
        return self.places.between((at.book_id, at.pos - before), (at.book_id, at.pos + after)).orderBy("pos")

    def neighbors_each(self, ids: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
        """``scene_id, around`` for each of ``ids``: the ids of the scenes around it, itself included, in order.

        Only the ranges that these scenes' surroundings lie in are read.
        """
        parts = self.places.newest()[1]
        lows = [p.low for p in parts]
        offsets = F.sequence(F.lit(-before), F.lit(after))
        wanted = self.get_each(ids).select("scene_id", "book_id", F.explode(F.transform(offsets, lambda o: F.col("pos") + o)).alias("pos"))
        hit = {r[0] for r in wanted.select(self.places.place(lows)).distinct().collect()} if parts else set()  # ranges
        near = self.places.read([parts[p] for p in sorted(hit)]).select("book_id", "pos", F.col("scene_id").alias("near"))
        listed = F.array_sort(F.collect_list(F.struct("pos", "near")))
        return wanted.join(near, ["book_id", "pos"]).groupBy("scene_id").agg(F.transform(listed, lambda x: x["near"]).alias("around"))

    def find(self, limit: int | None = None, order: bool = True, **filters) -> DataFrame:
        """As ``relational.find``, from the ranges that may hold such rows."""
        return relational.find(self.places.read([p for p in self.places.newest()[1] if self.may_hold(p, filters)]), limit, order, **filters)

    @staticmethod
    def may_hold(part: Part, filters: dict) -> bool:
        """Whether the statistics of a range leave room for rows that meet all filters."""
        known = json.loads(part.stats)
        for name, value in filters.items():
            many = isinstance(value, (list, tuple, set, frozenset))
            values = [str(v) for v in (value if many else [value]) if v is not None]
            if name in known.get("listed", {}):
                fits = any(v in known["listed"][name] for v in values)
            elif name in known.get("spans", {}):
                least, most = known["spans"][name]
                fits = least is not None and any(least <= v <= most for v in values)
            else:
                fits = True
            if not fits:
                return False
        return True
