"""Tables in parts, the vector index and the laid-out scene table: against plain versions, and what they read and write."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import relational, scenes
from quire.operators.vector_index import VectorIndex, bounds, recall, spherical_centres
from quire.sources.layout import SceneTable
from quire.sources.parts import Parts, RangedTable
from quire.streaming import ingest

EVENTS = "k string, u int, ts int, v int"


def newest(batches):
    out = {}
    for row in (r for b in batches for r in b):
        if row[:2] not in out or row[2] > out[row[:2]][2]:
            out[row[:2]] = row
    return sorted(map(str, out.values()))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("rows_per_part", [7, 40, 10_000])
def test_ranged_upserts_against_a_dictionary(spark, tmp_path, rows_per_part):
    r = random.Random(rows_per_part)
    table = RangedTable(spark, str(tmp_path), EVENTS, ["k", "u"], ["ts"], rows_per_part)
    assert table.table().isEmpty() and table.upsert(spark.createDataFrame([], EVENTS)) == {"parts": 0, "rows": 0, "of": 0}
    batches, n = [], 0
    for size in (30, 1, 200, 0, 60):
        batch = [(r.choice(["a", "b", "é", "日", "", None, 'q"'] + [f"x{i}" for i in range(30)]), r.choice([1, 2, 3, None]), (n := n + 1), i) for i in range(size)]
        batches.append(batch)
        table.upsert(spark.createDataFrame(batch, EVENTS))
        assert rows_of(table.table()) == newest(batches)
    low, high = ("b", None), ("x2", 3)
    key = lambda x: [(v is not None, v) for v in x]
    wanted = [x for b in [eval(x) for x in newest(batches)] for x in [b] if key(low) <= key(x[:2]) <= key(high)]
    assert rows_of(table.between(low, high)) == sorted(map(str, wanted))
    one = [x for x in map(eval, newest(batches)) if x[0] == "x1"]
    assert rows_of(table.between(("x1",), ("x1",))) == sorted(map(str, one))


def test_a_batch_rewrites_the_ranges_that_it_hits(spark, tmp_path):
    table = RangedTable(spark, str(tmp_path), "k long, v long", ["k"], ["v"], 1000)
    first = table.upsert(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")))
    assert first["rows"] == 20_000 and first["of"] >= 16
    near = table.upsert(spark.range(9_000, 9_050).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("v")))
    assert near["parts"] <= 2 and near["rows"] < 3_500
    assert table.table().groupBy("v").count().orderBy("v").collect() == [(1, 19_950), (2, 50)]
    grown = table.upsert(spark.range(20_000, 30_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")))
    assert grown["of"] >= first["of"] + 7 and grown["rows"] < 13_000  # the last range is cut anew
    assert max(p.rows for p in table.newest()[1]) <= 2_500
    few = table.between((15_000,), (15_010,))
    assert few.count() == 11 and len(few.inputFiles()) <= 2 < len(table.table().inputFiles())


def test_a_break_between_data_and_version_changes_nothing(spark, tmp_path, monkeypatch):
    batch = lambda *rows: spark.createDataFrame(list(rows), EVENTS)
    write = ingest.upsert_into(str(tmp_path), ["k", "u"], ["ts"], 2)
    table = ingest.table(spark, str(tmp_path), EVENTS, ["k", "u"], ["ts"])
    first, second = [("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 1)], [("a", 1, 5, 9), ("d", 1, 1, 1)]
    write(batch(*first), 0)
    whole = Parts.commit
    with monkeypatch.context() as m:
        m.setattr(Parts, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            write(batch(*second), 1)
        assert rows_of(table.table()) == newest([first])
    with monkeypatch.context() as m:  # and after it: the stream runs the batch again
        m.setattr(Parts, "commit", lambda *a: (whole(*a), (_ for _ in ()).throw(RuntimeError("late"))))
        with pytest.raises(RuntimeError, match="late"):
            write(batch(*second), 1)
    assert rows_of(table.table()) == newest([first, second])
    write(batch(*second), 1)
    write(batch(("a", 1, 2, 7)), 2)  # late
    assert rows_of(table.table()) == newest([first, second])
    assert table.forget(keep=1) >= 1 and rows_of(table.table()) == newest([first, second])


# -- vectors


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(size=16) * 0.15).tolist(), i % 3) for i in range(900)]
    rows += [(2000 + i, rows[5][1], 1) for i in range(40)]  # copies
    odd = [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [1.0], 1), (3003, [float("nan")] * 16, 1), (3004, [None, *[1.0] * 15], 1)]
    return rows + odd


def nearest(rows, queries, k):
    ok = lambda v: v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)
    held = sorted((i, np.array(v) / np.linalg.norm(v)) for i, v, *_ in rows if ok(v))
    out = set()
    for q, v in queries:
        if ok(v):
            scores = sorted((-round(float(np.dot(np.array(v) / np.linalg.norm(v), x)), 9), i) for i, x in held)
            out |= {(q, i) for _, i in scores[:k]}
    return out


def test_index_against_brute_force(spark, tmp_path, vectors):
    frame = spark.createDataFrame(vectors, "row long, v array<double>, label int")
    asked = [(i, v) for i, v, _ in vectors if i % 20 == 0 or i > 2990]
    queries = spark.createDataFrame(asked, "query long, v array<double>")
    index = VectorIndex(spark, str(tmp_path), "long", 16, "label int")
    assert index.search(queries, 3).isEmpty()
    with pytest.raises(ValueError, match="build"):
        index.upsert(frame)
    index.build(frame.where("row < 2000"), cells=24)
    pairs = lambda df: {(r.query, r.row) for r in df.collect()}
    assert pairs(index.search(queries, 7)) == nearest(vectors[:900], asked, 7)
    # some go to other places, some are new, one is taken out
    changed = [(i, vectors[i + 1][1], 2) for i in range(0, 40, 4)] + [(7, None, 0)] + vectors[900:]
    assert 0 < index.upsert(spark.createDataFrame(changed, frame.schema)) < 24
    now = {i: (i, v, x) for i, v, x in vectors[:900] + changed}.values()
    assert pairs(index.search(queries, 7)) == nearest(now, asked, 7)
    assert pairs(index.search(queries, 5, where=F.col("label") == 2)) == nearest([x for x in now if x[2] == 2], asked, 5)
    assert index.search(queries, 10_000).groupBy("query").count().select("count").distinct().first()[0] == 939
    exact = index.search(queries, 10)
    loss = recall(index.search(queries, 10, cells=3), exact).first()
    assert loss.recall >= 0.9 and loss.n == exact.count()
    # one query reads few cells
    one = index.search(queries.where("query = 20"), 5, cells=1)
    assert one.count() == 5
    index.build(frame.limit(0))
    assert index.search(queries, 3).isEmpty()


def test_bounds_hold():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = spherical_centres(x, 20)
    own = (x @ centres.T).argmax(axis=1)
    least = np.array([(x[own == c] @ centres[c]).min() if (own == c).any() else 1.0 for c in range(len(centres))])
    for q in x[:50]:
        most = bounds(centres @ q, least)
        assert all((x[own == c] @ q).max() <= most[c] for c in range(len(centres)) if (own == c).any())


# -- the scene table


def test_laid_out_scenes(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"{b}-{i}", f"{b}", i, "joy" if b < 20 else r.choice(["rage", "dread", None]), f"a{b}") for b in range(40) for i in range(25)] + [("odd", None, None, "joy", None)]
    table = spark.createDataFrame(rows, "scene_id string, book_id string, pos int, dominant_tone string, author string")
    table = scenes.dense_neighbor_tones(table).cache()
    laid = SceneTable(spark, f"{tmp_path}/scenes", table.schema, rows_per_part=100)
    assert laid.get("3-1").isEmpty() and laid.neighbors("3-1").isEmpty() and laid.find(book_id="3").isEmpty()
    laid.build(table, buckets=8)
    every = len(laid.by_place().inputFiles())
    assert every >= 8 and rows_of(laid.by_place()) == rows_of(table) == rows_of(laid.by_id())
    assert rows_of(laid.get("31-7")) == rows_of(relational.get(table, "31-7"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not say which buckets it reads
    assert "SelectedBucketsCount: 1 out of 8" in laid.get("31-7")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert rows_of(laid.neighbors("31-24", 2, 3)) == rows_of(relational.neighbors(table, "31-24", 2, 3))
    assert len(laid.neighbors("31-10", 2, 3).inputFiles()) <= 2
    assert laid.neighbors("odd").isEmpty() and laid.neighbors("9-99").isEmpty()
    for filters in ({"book_id": "7"}, {"dominant_tone": "dread", "prev_tone": "rage"}, {"book_id": ["3", "38"], "dominant_tone": "joy"}, {"dominant_tone": []}, {"author": "a12"}):
        assert rows_of(laid.find(**filters)) == rows_of(relational.find(table, **filters))
    assert len(laid.find(book_id="7").inputFiles()) <= 2
    assert 0 < len(laid.find(dominant_tone="dread").inputFiles()) < every  # half of the books have no such tone
    ids = table.where("pos % 5 = 0").select("scene_id")
    assert rows_of(laid.get_each(ids)) == rows_of(table.where("pos % 5 = 0"))
    plan = laid.get_each(spark.createDataFrame(ids.collect(), ids.schema).hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the ids alone
    around = relational.windows(table.where("pos is not null"), 2, 1).join(ids, "scene_id", "left_semi")
    assert rows_of(laid.neighbors_each(ids, 2, 1)) == rows_of(around)
    few = table.where("book_id = '5'").select("scene_id")
    assert len(laid.neighbors_each(few).inputFiles()) < every
    # a session that has not seen the buckets, and a second version
    spark.sql(f"drop table {laid._name(json.loads(laid.places.newest()[1][0].stats)['by_id'])}")
    assert rows_of(SceneTable(spark, f"{tmp_path}/scenes", table.schema).get("2-2")) == rows_of(relational.get(table, "2-2"))
    laid.build(table.where("pos < 3"), buckets=2)
    assert laid.by_id().count() == laid.by_place().count() == 120
