import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.vocabulary import FILTERS
from quire.operators import enrich, gates, paragraphs, relational, scenes, search, upsert

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def greedy(sizes, limit):
    parts, held = [], None
    for n in sizes:
        if held is None or held + n > limit:
            parts.append(0)
            held = 0
        held += n
        parts[-1] += 1
    return parts


@QUICK
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=30), min_size=1, max_size=20))
def test_greedy_packing(spark, books):
    rows = [(str(b), i, n) for b, sizes in enumerate(books) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "book_id string, idx long, n long")
    found = paragraphs.packed(table, ["book_id"], "idx", F.col("n"), 10).orderBy("book_id", "idx").collect()
    for b, sizes in enumerate(books):
        own = [r for r in found if r.book_id == str(b)]
        wanted = greedy(sizes, 10)
        assert [sum(r.part == p + 1 for r in own) for p in range(len(wanted))] == wanted
        assert [r.idx for r in own] == list(range(len(sizes))) and {r.part_count for r in own} == {len(wanted)}


def test_packing_edges(spark):
    table = lambda sizes: spark.createDataFrame([("b", i, n) for i, n in enumerate(sizes)], "book_id string, idx long, n long")
    parts = lambda sizes: [r.part for r in paragraphs.packed(table(sizes), ["book_id"], "idx", F.col("n"), 10).orderBy("idx").collect()]
    assert parts([4, 6, 1]) == [1, 1, 2]  # exactly full stays
    assert parts([11, 1, 99, 1]) == [1, 2, 3, 4]  # too large for any part, alone
    assert parts([0, 11]) == [1, 2]
    assert parts([]) == []


def lines_of(spark, segments):
    rows = [("b", s, f"h{s}", p, t) for s, texts in enumerate(segments) for p, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book_id string, segment int, heading string, para int, text string")


def test_segments_numbers_and_chunks(spark):
    table = lines_of(spark, [["x" * 199], ["y" * 120, "z" * 80], ["w" * 150] * 4])
    numbered = paragraphs.numbered(paragraphs.kept_segments(table))
    assert [(r.chapter, r.idx) for r in numbered.orderBy("idx").collect()] == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (1, 5)]
    made = paragraphs.chunks(numbered, limit=300).orderBy("chunk_index").collect()
    assert [(c.chapter_index, c.chapter_heading, c.part, c.part_count) for c in made] == [(0, "h1", 1, 1), (1, "h2", 1, 2), (1, "h2", 2, 2)]
    assert [[p.idx for p in c.context] for c in made] == [[], [0, 1], [1, 2, 3]]
    told = paragraphs.labelling_payload(paragraphs.chunks(numbered, limit=300)).orderBy("chunk_index")
    body = json.loads(told.collect()[2].payload)
    assert body["section_within_chunk"] == "2/2" and body["number_of_indexed_paragraphs"] == 2
    assert [p["index"] for p in body["indexed_paragraphs"]] == [4, 5]
    assert told.select(gates.expected_indices(F.col("payload")).alias("i")).collect()[2].i == [4, 5]
    whole = json.loads(paragraphs.inspection_payload(paragraphs.chunks(numbered)).first().payload)
    assert whole["context_count"] == 0 and whole["paragraph_count"] == len(whole["paragraphs"]) == 2


LABEL = "book_id string, ord long, start_paragraph_index long, end_paragraph_index long, open_start_index boolean, open_end_index boolean, title string, paragraph_type string, content_form string"


def loop_stitch(ranges):
    done = []
    for s, e, os, oe, title in ranges:
        if done and os and done[-1]["open"]:
            done[-1].update(e=e, open=oe, n=done[-1]["n"] + 1)
        else:
            done.append({"s": max(0, s - 1) if os else s, "e": e, "open": oe, "n": 1, "head": os, "t": title})
    status = lambda d: "broken_stitch" if d["open"] else "stitched" if d["n"] > 1 else "broken_stitch" if d["head"] else "complete"
    return [(i, d["s"], d["e"], d["t"], status(d)) for i, d in enumerate(done)]


@QUICK
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.booleans(), st.booleans()), max_size=12), max_size=10))
def test_stitching(spark, books):
    rows = [(str(b), i, s, s + n, os, oe, f"t{i}", "scene", "prose") for b, rs in enumerate(books) for i, (s, n, os, oe) in enumerate(rs)]
    found = scenes.stitched(spark.createDataFrame(rows, LABEL)).collect()
    for b, rs in enumerate(books):
        own = sorted((r.scene, r.start, r.end, r.title, r.stitch_status) for r in found if r.book_id == str(b))
        assert own == loop_stitch([(s, s + n, os, oe, f"t{i}") for i, (s, n, os, oe) in enumerate(rs)])


def test_records(spark):
    texts = spark.createDataFrame([("7", i, f" p{i} <i>x</i>", f"ch{i // 3}") for i in range(8)], "book_id string, idx long, text string, chapter_title string")
    labels = spark.createDataFrame(
        [
            ("7", 0, 0, 1, False, True, "one", "scene", "prose"),
            ("7", 1, 2, 2, False, False, "NOISE", "scene", "noise"),
            ("7", 2, 3, 4, True, False, "two", "scene", "prose"),
            ("7", 3, 6, 5, True, False, "three", "scene", "prose"),
        ],
        LABEL,
    )
    meta = spark.createDataFrame([("7", "l", "A B", None, "T", ["s"], None, "en")], "ID string, Link string, Author string, Translator string, Title string, Subjects array<string>, Date string, Language string")
    made = scenes.records(labels, texts, meta).orderBy("scene_id").collect()
    assert len(made[0]) == 24
    assert [(r.scene_id, r.prev_scene_id, r.next_scene_id, r.stitch_status) for r in made] == [("7-0", None, "7-1", "stitched"), ("7-1", "7-0", None, "broken_stitch")]
    assert made[0].text_html == "<p>p0 <i>x</i></p><p>p1 <i>x</i></p><p>p2 <i>x</i></p><p>p3 <i>x</i></p><p>p4 <i>x</i></p>"
    assert made[0].word_count == 10 and made[0].author == "A B" and made[0].book_metadata.Title == "T"
    assert made[1].start_paragraph_index == 5 and made[1].chapter_title == "ch1" and made[1].text_html.startswith("<p>p5")


def test_gates(spark):
    rows = [("Public domain in the USA.", ["Displays"]), (None, ["x"]), ("Public domain in the USA.", ["Fiction"]), ("public domain", ["Poetry"])]
    table = spark.createDataFrame(rows, "rights string, subjects array<string>")
    assert [r[0] for r in table.select(gates.book_gate(F.col("rights"), F.col("subjects"))).collect()] == ["subjects", "rights", None, "rights"]
    labels = [("a", 0, 0, 6, False, False, "t", "scene", "other"), ("a", 1, 7, 9, False, False, "t", "scene", "prose"), ("b", 0, 0, 7, False, False, "t", "scene", "other"),
              ("b", 1, 8, 9, False, False, "t", "scene", "prose"), ("c", 0, 0, 3, False, False, "NOISE", "scene", "other")]
    found = {r.book_id: r for r in gates.share_of_other(spark.createDataFrame(labels, LABEL)).collect()}
    assert found["a"].other_share == pytest.approx(0.7) and found["a"].passes and not found["b"].passes
    assert found["c"].kept == 0 and found["c"].noise == 4 and found["c"].passes


@QUICK
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(-3, 5)), max_size=8))
def test_coverage(spark, ranges):
    from collections import Counter

    table = spark.createDataFrame([("k", s, s + n) for s, n in ranges], "k string, start int, end int")
    wanted = spark.createDataFrame([("k", i) for i in range(8)], "k string, idx int")
    found = gates.coverage(wanted, table, "k").first()
    times = Counter(i for s, n in ranges for i in range(s, s + n + 1))
    missing, extra, twice = [i for i in range(8) if not times[i]], sorted(i for i in times if i > 7), sorted(i for i in times if times[i] > 1)
    assert (found.missing, found.extra, found.repeated, found.valid) == (missing, extra, twice, not (missing or extra or twice))


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = [(f"{b}-{i}", str(b), i, r.choice(["joy", "rage", None]), "en", bool(i % 2)) for b in range(5) for i in range(6)]
    raw = spark.createDataFrame(rows, "scene_id string, book_id string, pos int, dominant_tone string, language string, enriched boolean")
    return scenes.dense_neighbor_tones(raw).cache()


def test_lookups(spark, table):
    ids = lambda df: [r.scene_id for r in df.collect()]
    assert ids(relational.find(table, limit=3)) == ["0-0", "0-1", "0-2"]
    assert len(ids(relational.find(table, limit=-1))) == 30
    assert relational.find(table, book_id=3).count() == 6 and relational.find(table, enriched=True).count() == 15
    assert relational.find(table, dominant_tone=[]).count() == relational.find(table, dominant_tone=None).count() == 0
    assert relational.find(table, dominant_tone=["joy", None]).count() == table.where("dominant_tone = 'joy'").count()
    with pytest.raises(KeyError):
        relational.find(table, pos=1)
    with pytest.raises(KeyError):
        relational.tally(table, "word_count")
    assert relational.count(table, book_id="1").first().n == 6
    assert sum(r.n for r in relational.tally(table, "dominant_tone").collect()) == 30
    assert ids(relational.neighbors(table, "2-0", 2, 1)) == ["2-0", "2-1"] and ids(relational.neighbors(table, "9-9")) == []
    around = {r.scene_id: r.around for r in relational.windows(table).collect()}
    assert around["1-3"] == ["1-2", "1-3", "1-4"] and around["1-5"] == ["1-4", "1-5"]
    assert ids(relational.get(table, "4-4")) == ["4-4"]
    assert len(FILTERS) == 11


def test_neighbor_tones_agree(table):
    dense = table.select("scene_id", "prev_tone", "next_tone")
    named = table.withColumn("prev_scene_id", F.concat_ws("-", "book_id", F.col("pos") - 1)).withColumn("next_scene_id", F.concat_ws("-", "book_id", F.col("pos") + 1))
    joined = scenes.neighbor_tones(named).select("scene_id", "prev_tone", "next_tone")
    assert joined.exceptAll(dense).count() == dense.exceptAll(joined).count() == 0
    part = scenes.neighbor_tones(named.where("pos <> 2")).where("scene_id = '0-3'").first()
    assert part.prev_tone is None


def replace_loop(old, new):
    held = {r[0]: r for r in old}
    for r in new:
        for k in [k for k, v in held.items() if k == r[0] or (v[1] == r[1] and v[2] == r[2] and r[2] is not None)]:
            del held[k]
        held[r[0]] = r
    return sorted(map(str, held.values()))


def test_upserts(spark):
    schema = "scene_id string, book_id string, pos int, n int"
    old = [("1-0", "1", 0, 1), ("1-1", "1", 1, 1), ("x", "1", None, 1), ("odd", "1", 2, 1)]
    new = [("1-1", "1", 1, 2), ("1-1", "1", 1, 3), ("1-2", "1", 2, 4), ("y", "1", None, 5)]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    assert sorted(str(tuple(r)) for r in upsert.replaced(a, b, ["n"]).collect()) == replace_loop(old, new)
    assert upsert.merged(a, b, ["scene_id"], ["n"]).count() == 6
    r = random.Random(3)
    for _ in range(4):  # ids that move to other places, and places that get other ids
        old = [(f"i{i}", "1", i, 0) for i in range(8)]
        new = [(f"i{r.randrange(10)}", "1", r.choice([None, *range(9)]), n) for n in range(1, 12)]
        a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
        assert sorted(str(tuple(x)) for x in upsert.replaced(a, b, ["n"]).collect()) == replace_loop(old, new)
    assert upsert.replaced(a, b.limit(0), ["n"]).count() == 8


def test_books_are_overwritten_one_by_one(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "book_id string, n int")
    upsert.write_books(rows(("a", 1), ("b", 1)), str(tmp_path))
    upsert.write_books(rows(("b", 2)), str(tmp_path))
    assert sorted((r.book_id, r.n) for r in spark.read.parquet(str(tmp_path)).collect()) == [("a", 1), ("b", 2)]


def embed(texts):
    return [[float(1 + t.count(c)) for c in "abcdefgh"] for t in texts]


def test_searches(spark):
    rows = [(f"1-{i}", "1" if i % 2 else "2", f"{'a' * i} summary", ["bb" * (i % 5)] if i % 3 else []) for i in range(80)] + [("1-99", "1", None, None)]
    table = spark.createDataFrame(rows, "scene_id string, book_id string, summary string, descriptors array<string>")
    index = enrich.indexed(table, embed).cache()
    assert index.count() == 80
    hits = search.search_summary(index, embed, "aaaa", limit=5).collect()
    assert len(hits) == 5 and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert {r.book_id for r in search.search_summary(index, embed, "aaaa", where=search.book_filter("1")).collect()} == {"1"}
    pool = {h.scene_id for h in search.search_summary(index, embed, "aaaa", limit=50).collect()}
    ranked = search.search_summary(index, embed, "aaaa", "bbbb", limit=5).collect()
    assert {h.scene_id for h in ranked} <= pool
    both = search.search_combined(index, embed, "aaaa", search.Terms(["bbbb", "cc"], [0.5, 0.5], ["hh"], [1.0], 0.2))
    assert both.count() == 5
    assert search.search_weighted_descriptors(index, embed, search.Terms(["bb"])).count() == 5
    for wrong in (lambda: search.search_summary(index, embed, ""), lambda: search.search_combined(index, embed, "a", search.Terms([])), lambda: search.search_weighted_descriptors(index, embed, search.Terms([]))):
        with pytest.raises(ValueError):
            wrong()
    assert search.book_filter("") is None


def enricher(payload, notes, warmth):
    items = [
        {"index": s["index"], "dominant_tone": "joy", "intensity": "low", "arc": "steady", "descriptors": [" A", "b", "c", "d", "e"], "summary": f"scene of {len(s['text'])}. "}
        for s in json.loads(payload)["scenes"]
    ]
    return json.dumps({"items": items})


def test_enrichment(spark):
    rows = [(f"1-{i}", "1", i, f"1-{i - 1}" if i else None, f"1-{i + 1}" if i < 5 else None, "t", "c", "<p>" + "x" * 50 + "</p>") for i in range(6)]
    raw = spark.createDataFrame(rows, "scene_id string, book_id string, pos int, prev_scene_id string, next_scene_id string, scene_title string, chapter_title string, text_html string")
    for name, kind in (("dominant_tone", "string"), ("intensity", "string"), ("arc", "string"), ("descriptors", "array<string>"), ("prev_tone", "string"), ("next_tone", "string"), ("summary", "string"), ("enrich_model", "string")):
        raw = raw.withColumn(name, F.lit(None).cast(kind))
    raw = raw.withColumn("enriched", F.lit(False))
    batches = enrich.batched(raw, limit=120)
    assert [(r.batch, r["index"]) for r in batches.orderBy("pos").collect()] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]
    facets = enrich.ask(batches, enricher)
    full = enrich.applied(raw, facets.where("scene_id <> '1-5'"), "stub").orderBy("pos")
    got = full.collect()
    assert got[0].summary == "Scene of 50." and got[0].descriptors == ["a", "b", "c", "d", "e"] and got[0].enrich_model == "stub"
    assert [r.prev_tone for r in got] == [None, "joy", "joy", "joy", "joy", "joy"] and got[4].next_tone is None
    assert [r.scene_id for r in enrich.todo(full).collect()] == ["1-5"]
    assert enrich.todo(raw, facets.where("scene_id < '1-3'")).count() == 3
    bare = enrich.reset(full, "tone", "enriched").first()
    assert bare.dominant_tone is None and bare.summary is None and bare.enriched is False and bare.arc == "steady"
    assert all(r.arc is None and r.summary is None for r in enrich.reset(full).collect())
    flat = relational.mirror(full.withColumns({c: F.lit(None).cast("string") for c in ("author", "language", "stitch_status")}).withColumns({c: F.lit(1) for c in ("word_count", "start_paragraph_index", "end_paragraph_index", "schema_version")}))
    assert len(flat.columns) == 23 and flat.first().enriched == 1
    assert relational.reinflated(flat).orderBy("pos").first().descriptors == ["a", "b", "c", "d", "e"]
    odd = spark.createDataFrame([("joy", "low", "steady", ["a"], "s"), ("calm", "low", "steady", list("abcde"), "s")], "dominant_tone string, intensity string, arc string, descriptors array<string>, summary string")
    assert [r.valid for r in enrich.normalised(odd).collect()] == [False, False]
