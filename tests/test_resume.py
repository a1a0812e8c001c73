"""Work that breaks and goes on: checkpoints, threads, vectors by content, archives that keep arriving."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_operators import embed
from test_sources import PAGE, zipped

from quire.functions import hooks
from quire.operators import enrich
from quire.operators.upsert import latest
from quire.sources import tables
from quire.streaming import archives


def test_order_of_answers_and_pace():
    assert hooks.in_order(lambda x: (time.sleep(0.02 * (5 - x)), x)[1], list(range(5)), 5) == list(range(5))
    busy, most, lock = [0], [0], threading.Lock()

    def work(x):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.01)
        with lock:
            busy[0] -= 1

    hooks.in_order(work, list(range(30)), 3)
    assert 2 <= most[0] <= 3
    begun = []
    with pytest.raises(ZeroDivisionError):
        hooks.in_order(lambda x: (begun.append(x), 1 / x if x == 0 else time.sleep(0.05)), list(range(50)), 2)
    assert len(begun) < 20
    clock, slept = [0.0], []
    pace = hooks.Pace(4, clock=lambda: clock[0], sleep=slept.append)
    for _ in range(3):
        pace.wait()
    clock[0] = 10.0
    pace.wait()
    assert slept == [0.0, 0.25, 0.5, 0.0]
    tries = []
    assert hooks.insisted(lambda: tries.append(1) or (len(tries) > 2 and "done") or (_ for _ in ()).throw(TimeoutError()), sleep=lambda s: None) == "done"
    with pytest.raises(KeyError):
        hooks.insisted(lambda: {}[1], sleep=lambda s: None)


def spoken(log, breaks=()):
    def model(payload, notes, warmth):
        with open(log, "a") as f:
            f.write(payload + "\n")
        if payload in breaks:
            time.sleep(3)  # the other tasks have ended by then
            raise RuntimeError("killed")
        return '{"n": 1}' if not payload.endswith("7") else "no"

    return model


def test_a_killed_run_asks_only_for_what_is_missing(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "store")
    inputs = spark.createDataFrame([(f"b{i % 3}", i, f"payload {i}") for i in range(60)], "book_id string, chunk_index int, payload string")
    keys = ["book_id", "chunk_index", "payload"]
    asked = lambda: open(log).read().split("\n")[:-1]
    make = lambda breaks=(): lambda rows: hooks.answered(rows, spoken(log, breaks), "n int", threads=2)
    store = tables.Store(folder, every=5)
    with pytest.raises(Exception, match="killed"):
        store.resumed(inputs, "answers", keys, make(("payload 33",)))
    first = asked()
    assert "payload 33" in first and len(first) > 30
    group, jobs = "one", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    found = store.resumed(inputs, "answers", keys, make())
    spark.sparkContext._jsc.clearJobGroup()
    rows = {r.chunk_index: r for r in found.collect()}
    assert len(rows) == 60 and {i for i, r in rows.items() if r.failure} == {7, 17, 27, 37, 47, 57}
    assert "codec" not in found.columns and found.columns == [*keys, "answer", "failure"]
    second = asked()[len(first) :]
    assert {"payload 33"} <= set(second) and len(set(second)) <= 60 - 25  # what the ended tasks had is not asked again
    assert len(jobs.getJobIdsForGroup(group)) < 15
    third = len(asked())
    store.resumed(inputs, "answers", keys, make()).count()
    assert {p[-1] for p in asked()[third:]} == {"7"}  # failures alone
    fourth = len(asked())
    tables.Store(folder, every=50, codec="2").resumed(inputs, "answers", keys, make()).count()
    assert len(set(asked()[fourth:])) == 60  # another codec's rows are refused
    store.clear("answers", spark.createDataFrame([("b0",), ("b1",), ("no",)], "book_id string"))
    assert {r.book_id for r in store.kept(spark, "answers", inputs.schema).collect()} == {"b2"}
    assert os.listdir(f"{folder}/answers") == ["codec=1"] and len([x for x in os.listdir(f"{folder}/answers/codec=1") if x[0] != "."]) == 1
    fifth = len(asked())
    store.resumed(inputs.where("book_id = 'b2'"), "answers", keys, make()).count()
    assert {p[-1] for p in asked()[fifth:]} <= {"7"}
    store.clear("answers", inputs)
    assert store.kept(spark, "answers", inputs.schema).isEmpty()


def test_vectors_are_remembered(spark, tmp_path):
    log = str(tmp_path / "log")

    def counted(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return embed(texts)

    rows = [(f"1-{i}", f"summary {i % 7}", ["x", "y"] if i % 2 else []) for i in range(40)] + [("1-99", None, None)]
    scenes = spark.createDataFrame(rows, "scene_id string, summary string, descriptors array<string>")
    vectors = tables.remembered(str(tmp_path / "vectors"), "v1")
    same = lambda df: sorted(map(str, df.select("scene_id", "summary_vec", "descriptors_vec").collect()))
    first = enrich.indexed(scenes, counted, vectors)
    assert same(first) == same(enrich.indexed(scenes, embed)) and first.columns == enrich.indexed(scenes, embed).columns
    assert sorted(open(log).read().split()) == sorted(" ".join([f"summary {i}" for i in range(7)] + ["x, y"]).split())
    size = os.path.getsize(log)
    assert same(enrich.indexed(scenes, counted, vectors)) == same(first) and os.path.getsize(log) == size  # no call
    more = scenes.union(spark.createDataFrame([("2-1", "new", None)], scenes.schema))
    assert enrich.indexed(more, counted, vectors).count() == 41 and open(log).read().endswith("x, y\nnew\n")
    other = tables.remembered(str(tmp_path / "vectors"), "v2")
    enrich.indexed(scenes, counted, other).count()
    assert os.path.getsize(log) > 2 * size - 5  # another model
    nothing = vectors(scenes.where("summary is null"), "summary", "v", counted)
    assert [r.v for r in nothing.collect()] == [None]


def test_archives_that_keep_arriving(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    page = lambda word, n: "".join(f"<p>{word * 60} {i}</p>" for i in range(n))

    def put(name, html, at):
        data = zipped("x.htm", html) if html is not None else b"no zip"
        (folder / name).write_bytes(data)
        os.utime(folder / name, (at, at))

    def run(n=1000):
        archives.start(spark, str(folder), path, str(tmp_path / "marks"), n).awaitTermination()
        return {(r.book_id, r.n): r.first[:3] for r in archives.table(spark, path).groupBy("book_id").agg(F.count("*").alias("n"), F.min("text").alias("first")).collect()}

    put("pg1-h.zip", page("one ", 5), 1000)
    put("pg2-h.zip", page("two ", 3), 1000)
    put("pg3-h.zip", None, 1000)
    put("notes.zip", page("no ", 3), 1000)
    assert run(1) == {("1", 5): "one", ("2", 3): "two"}
    assert run() == {("1", 5): "one", ("2", 3): "two"}  # a restart finds nothing new
    put("newpg1-h.zip", page("new ", 2), 2000)  # the book comes again
    assert run() == {("1", 2): "new", ("2", 3): "two"}
    put("oldpg1-h.zip", page("old ", 9), 500)  # and an older one, late
    put("pg4-h.zip", PAGE, 3000)  # too short to keep
    whole = archives.RangedTable.upsert
    with monkeypatch.context() as m:  # a break after the paragraphs are written
        m.setattr(archives.RangedTable, "upsert", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    assert archives.RangedTable.upsert is whole
    assert run() == {("1", 2): "new", ("2", 3): "two"}
    put("againpg2-h.zip", "<p>nothing</p>", 9000)
    assert run() == {("1", 2): "new"}
    assert {r.book_id for r in archives.books(spark, path).table().collect()} == {"1", "2", "4"}
    assert latest(archives.books(spark, path).table(), ["book_id"], ["modified"]).count() == 3


def test_checkpoints_keep_no_payloads_and_chunks_move_texts_once(spark, tmp_path):
    from quire.operators import paragraphs

    docs = spark.createDataFrame([(i, "\n".join("w" * (1 + (i * j) % 40) for j in range(60))) for i in range(30)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    numbered = paragraphs.numbered(paragraphs.lines(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text"))
    made = paragraphs.chunks(numbered, 200, 2)
    rows = sorted((r.book_id, r.chunk_index, [p.idx for p in r.context], [p.idx for p in r.paragraphs]) for r in made.collect())
    texts = {(r.book_id, r.idx): r.text for r in numbered.collect()}
    for book, _, context, own in rows:
        assert context == list(range(max(0, own[0] - 2), own[0])) and (len(own) == 1 or sum(len(texts[book, i]) for i in own) <= 200)
    assert sorted((b, i) for b, _, _, own in rows for i in own) == sorted(texts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = paragraphs.chunks(numbered, 200, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("Join" in line for line in plan.splitlines()) == 0  # texts meet their chunks by sorting, not by a join for each paragraph
    store = tables.Store(str(tmp_path / "store"), every=50)
    payloads = paragraphs.labelling_payload(made)
    make = lambda rows: rows.withColumns({"answer": F.upper("payload"), "failure": F.lit(None).cast("string")})
    keys = ["book_id", "chunk_index", "payload"]
    found = store.resumed(payloads, "told", keys, make)
    assert found.where("answer = upper(payload)").count() == payloads.count() == len(rows)
    assert "payload" not in spark.read.parquet(str(tmp_path / "store/told/codec=1")).columns
    changed = payloads.withColumn("payload", F.concat("payload", F.lit(" ")))
    assert store.resumed(changed, "told", keys, make).where("answer = upper(payload)").count() == len(rows)


def test_tables_of_books_have_a_folder_for_each_run(spark, tmp_path):
    store, rows = tables.Store(str(tmp_path)), lambda *r: spark.createDataFrame(list(r), "book_id string, n int")
    store.books(rows(*[(str(i), i) for i in range(40)], (None, 1), ("3", 4)), "t")
    found = store.books(rows(("3", 9), ("x", 1), (None, 2)), "t")
    assert sorted((r.book_id or "", r.n) for r in found.collect()) == sorted([*[(str(i), i) for i in range(40) if i != 3], ("3", 9), ("x", 1), ("", 2)])
    assert len([x for x in os.listdir(tmp_path / "t") if x[0] not in "._"]) == 3  # an empty one, and one a run


def test_json_files_of_books_are_put_in_place_by_tasks(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "j"), lambda *r: spark.createDataFrame(list(r), "book_id string, n int")
    asked = []
    writer = type(rows(("a", 1)).write)
    whole = writer.mode
    monkeypatch.setattr(writer, "mode", lambda self, m: asked.append(m) or whole(self, m))
    tables.write_json(rows(("a", 1), ("b", 1)), path)
    tables.write_json(rows(("b", 2)), path)
    assert [m for m in asked if m] == ["append", "overwrite"]
    assert sorted((r.book_id, r.n) for r in tables.read_json(spark, path, "book_id string, n int", lines=True).collect()) == [("a", 1), ("b", 2)]
