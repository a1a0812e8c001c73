import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import enrich, gates, paragraphs
from quire.plans import flow
from quire.sources import archive, catalog, tables
from quire.sources.tables import written
from quire.streaming import ingest

PAGE = """<html><head><meta name="dc.rights" content=" Public domain in the USA. "></head><body><!-- gone -->
<div id="pg-header"><p>boiler</p></div><p>loose one</p>
<div class="chapter x"><h2>I. <i>Start</i></h2><p>First <b class="k">bold</b> <a href="#">link</a> &amp; more<br>line</p><p>  </p></div>
<div class="chapter"><p>Second</p></div><section id="pg-footer"><p>end</p></section></body></html>"""


def zipped(name, raw):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr(name, raw)
    return held.getvalue()


def test_segments_by_chapter():
    assert archive.segments(PAGE) == [
        ("Front Matter", ["loose one"]),
        ("I. Start", ["First <b>bold</b> link &amp; more<br/>line"]),
        (None, ["Second"]),
    ]


def test_segments_by_heading_and_whole():
    page = "<body><p>before</p><h2>A</h2><p>one</p><h3>empty</h3><h1>B</h1><p>two <span>x</span></p></body>"
    assert archive.segments(page) == [(None, ["before"]), ("A", ["one"]), ("B", ["two x"])]
    assert archive.segments("<h1>only</h1><p>a<p>b") == [(None, ["ab", "b"])]  # an open paragraph holds the next one
    assert archive.segments("<h1>none</h1>") == [] == archive.segments("")


def test_page_text():
    assert archive.page_text("<body><!-- c --><p> a </p>\n<p>b<i>c</i></p></body>") == "a\nb\nc"


def test_pages_go_to_python_in_bounded_pieces(spark):
    page = "<h2>a</h2>" + "<p>xxxxx</p>" * 4
    pieces = list(archive.cut_pages(((str(i), page) for i in range(7)), chars=40))
    assert [len(p) for p in pieces] == [8, 8, 8, 4] and sum(pieces, []) == sum(archive.cut_pages((str(i), page) for i in range(7)), [])
    assert list(archive.cut_pages([("1", None)])) == [[]]
    pages = spark.range(1000).selectExpr("id as page_id", f"'{page}' as html")
    assert archive.paragraphs(pages, "page_id").count() == 4000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= archive.BATCH


def test_charsets_are_those_declared():
    of = lambda page, charset: archive.decoded(zipped("x.html", page.encode(charset)))
    for page, charset in (
        ("<meta charset='utf-8'><p>From ASCII, caf\xe9, to ISO-8859-1", "utf-8"),
        ("<meta charset='ISO-8859-1'><p>caf\xe9 in ascii or utf-8", "latin-1"),
        ('<?xml version="1.0" encoding="UTF-8"?><title>ascii caf\xe9', "utf-8"),
        ('<meta http-equiv="Content-Type" content="text/html; charset=us-ascii"><p>utf-8', "ascii"),
        ("<title>iso-8859-1</title>caf\xe9", "latin-1"),
        ("<p>&lt;meta charset='ascii'&gt;</p><meta charset=utf-8>caf\xe9", "utf-8"),
    ):
        assert of(page, charset) == page
    with pytest.raises(UnicodeDecodeError):
        of("<meta charset='us-ascii'>caf\xe9", "utf-8")


def test_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    (folder / "pg11-h.zip").write_bytes(zipped("x.htm", PAGE))
    (folder / "pg12-h.zip").write_bytes(zipped("x.html", '<meta charset="iso-8859-1"><p>caf\xe9</p>'.encode("latin-1")))
    (folder / "other.zip").write_bytes(b"")
    (folder / "pg13-h.txt").write_text("no")
    found = archive.archives(spark, str(folder))
    assert sorted(r.book_id for r in found.collect()) == ["11", "12"]
    pages = archive.pages(found)
    rows = archive.paragraphs(pages).orderBy("book_id", "segment", "para").collect()
    assert [(r.book_id, r.text) for r in rows][-1] == ("12", "café") and len(rows) == 4
    (folder / "pg14-h.zip").write_bytes(b"broken")
    rights = {r.book_id: r.rights for r in archive.archive_rights(archive.archives(spark, str(folder))).collect()}
    assert rights == {"11": "Public domain in the USA.", "12": None, "14": None}
    assert sorted(r.book_id for r in archive.pages(archive.archives(spark, str(folder))).collect()) == ["11", "12"]


def test_rights_keep_empty_apart_from_missing(spark):
    rows = spark.createDataFrame([('NAME="dc.rights"  content="x"',), ('name="dc.rights" content=""',), ("no",), (None,)], "h string")
    assert [r[0] for r in rows.select(archive.rights(F.col("h"))).collect()] == ["x", "", None, None]


def test_pages_table_against_the_parser(spark):
    page = spark.read.parquet("/root/testdata/sf0.001/pages.parquet") if os.path.exists("/root/testdata") else spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    found = archive.paragraphs(page, "page_id", "html").count()
    assert found == sum(len(t) for r in page.collect() for _, t in archive.segments(r.html or ""))


CATALOG = '''Text#,Type,Issued,Title,Language,Authors,Subjects
11,Text,2008-06-07,"Alice, in
two lines",en,"Carroll, Lewis, 1832-1898; Doe, Jane [Translator]","Fantasy; Children; Fantasy"
12,Text,,Old,fr,,
12,Text,,New ""x"",fr,"Voltaire",Plays
'''


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(CATALOG.replace('New ""x""', '"New ""x"""'))
    rows = {r.ID: r for r in catalog.metadata(catalog.read(spark, str(path))).collect()}
    assert rows["11"].Author == "Lewis Carroll" and rows["11"].Translator == "Jane Doe" and rows["11"].Date == "June 7, 2008"
    assert rows["11"].Title == "Alice, in\ntwo lines" and rows["11"].Subjects == ["Children", "Fantasy"]
    assert rows["12"].Title == 'New "x"' and rows["12"].Date is None and rows["12"].Link.endswith("/12")
    one = catalog.metadata(catalog.read(spark, str(path)), spark.createDataFrame([("11",)], "code string"))
    assert [r.ID for r in one.collect()] == ["11"]
    with pytest.raises(Exception, match="not in the catalog: 99"):
        catalog.metadata(catalog.read(spark, str(path)), spark.createDataFrame([("99",)], "code string")).collect()


def test_read_through(spark, tmp_path):
    made = []

    def make(rows):
        made.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("n", F.length("k"))

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    path = str(tmp_path / "cache")
    assert tables.read_through(keys("a", "bb"), path, "k string, n int", "k", make).count() == 2
    assert sorted((r.k, r.n) for r in tables.read_through(keys("bb", "ccc"), path, "k string, n int", "k", make).collect()) == [("bb", 2), ("ccc", 3)]
    assert made == [["a", "bb"], ["ccc"]]


def test_json_files(spark, tmp_path):
    (tmp_path / "pg5-s.json").write_text('[{"scene_id": "5-0"}]')
    (tmp_path / "pgbad-s.json").write_text("{oops")
    (tmp_path / "other.json").write_text('{"scene_id": "no"}')
    rows = {r.book_id: r for r in tables.scene_files(spark, str(tmp_path), "scene_id string").collect()}
    assert rows["5"].scene_id == "5-0" and rows["bad"].scene_id is None and len(rows) == 2
    assert tables.scene_files(spark, str(tmp_path), "scene_id string", ["5"]).count() == 1
    path = str(tmp_path / "d" / "x.json")
    tables.write_small({"é": 1}, path)
    assert tables.read_small(path) == {"é": 1} and "é" in open(path, encoding="utf-8").read()
    assert tables.read_text(str(tmp_path / "pgbad-s.json")) == "{oops" and tables.read_text(str(tmp_path / "no"), "d") == "d"
    assert tables.read_small(str(tmp_path / "pgbad-s.json"), 0) == 0 and tables.read_small(str(tmp_path / "none")) is None
    tables.write_json(spark.createDataFrame([("a", None), ("b", 1)], "book_id string, n int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    status = spark.createDataFrame([("a", "open")], "book_id string, status string")
    done = tables.marked(status, spark.createDataFrame([("a",), ("b",)], "book_id string"))
    assert {(r.book_id, r.status) for r in done.collect()} == {("a", "completed"), ("b", "completed")}
    assert tables.unmarked(done, status).count() == 1


def labeller(payload, notes, warmth):
    body = json.loads(payload)
    at = [p["index"] for p in body["indexed_paragraphs"]]
    one = {"start_paragraph_index": at[0], "end_paragraph_index": at[-1], "paragraph_type": "scene", "content_form": "prose", "open_start_index": body["section_within_chunk"][0] != "1", "open_end_index": not body["section_within_chunk"].endswith(body["section_within_chunk"][0]), "title": f"s{at[0]}"}
    return json.dumps({"scenes_data": [one]})


def test_the_whole_flow(spark, tmp_path):
    from test_operators import embed, enricher

    body = "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(200))
    pages = spark.createDataFrame([("11", f"<body>{body}</body>"), ("12", f"<body>{body}</body>"), ("13", "<p>short</p>")], "book_id string, html string")
    schema = "ID string, Link string, Author string, Translator string, Title string, Subjects array<string>, Date string, Language string"
    meta = spark.createDataFrame([(i, "l", "A", None, "T", [s], None, "en") for i, s in (("11", "x"), ("12", "Plays"), ("13", "x"))], schema)
    rights = spark.createDataFrame([(i, "Public domain in the USA.") for i in ("11", "12", "13")], "book_id string, rights string")
    store = tables.stored(str(tmp_path))
    numbered = store(flow.to_paragraphs(pages), "paragraphs")
    records, excluded = flow.to_scenes(numbered, meta, rights, labeller, store)
    got = records.orderBy("scene_id").collect()
    assert {r.book_id for r in got} == {"11"} and [(r.book_id, r.reason, r.detail) for r in excluded.collect()] == [("12", "subjects", "Plays")]
    assert got[0].start_paragraph_index == 0 and sum(r.word_count for r in got) >= 200 * 51
    assert paragraphs.chunks(numbered.where("book_id = '11'")).count() == 2
    mirror, index = flow.to_index(records, enricher, embed, "stub", store)
    assert mirror.where("enriched = 1").count() == index.count() == len(got)
    none = spark.createDataFrame([], "book_id string, status string")
    silent = tables.Store(str(tmp_path / "again"))
    flow.to_index(records, enricher, embed, "stub", silent, status=none)
    status = spark.read.parquet(str(tmp_path / "again/status"))
    assert [tuple(r) for r in status.collect()] == [("11", "completed")]
    mute, _ = flow.to_index(records, lambda *a: 1 / 0, embed, "stub", tables.Store(str(tmp_path / "third")), status=written(status, str(tmp_path / "marks")))
    assert mute.where("enriched = 1").count() == 0  # a completed book is not asked about
    chunked = paragraphs.chunks(numbered)
    back = paragraphs.from_inspection(paragraphs.inspection_payload(chunked))
    assert back.columns == chunked.columns and back.exceptAll(chunked).isEmpty() and chunked.exceptAll(back).isEmpty()
    dump = paragraphs.payload_dump(chunked)
    tables.write_json(dump, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).selectExpr("sum(size(payloads)) as n").first().n == chunked.count()
    again = spark.read.parquet(f"{tmp_path}/enriched").limit(1)
    for old, n in ((index, len(got)), (index.withColumnRenamed("summary_vec", "other"), 1), (None, 1)):
        rows, fresh = flow.refreshed(mirror, old, again, embed)
        assert rows.count() == len(got) and fresh.count() == n


def test_answers_are_checked_kept_and_asked_for_again(spark, tmp_path):
    """A labeller that skips paragraphs is asked again; what it never gets right is reported and asked for in the next run."""
    body = "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(300))
    pages = spark.createDataFrame([(b, f"<body>{body}</body>") for b in ("11", "12")], "book_id string, html string")
    schema = "ID string, Link string, Author string, Translator string, Title string, Subjects array<string>, Date string, Language string"
    meta = spark.createDataFrame([(i, "l", "A", None, "T", ["x"], None, "en") for i in ("11", "12", "13")], schema)
    rights = spark.createDataFrame([(i, "Public domain in the USA." if i != "13" else "other") for i in ("11", "12", "13")], "book_id string, rights string")
    numbered = written(flow.to_paragraphs(pages), str(tmp_path / "paragraphs"))
    folder, log = str(tmp_path / "store"), str(tmp_path / "log")

    def spoken(fails):
        def model(payload, notes, warmth):
            with open(log, "a") as f:
                f.write("x\n")
            answer = json.loads(labeller(payload, notes, warmth))
            first = answer["scenes_data"][0]
            if fails and first["start_paragraph_index"] == 0:
                return "{broken"
            if not notes:  # one paragraph short at first
                first["end_paragraph_index"] -= 1
            return json.dumps(answer)

        return model

    hooked = flow.answered
    flow.answered = lambda rows, model, kind, check: hooked(rows, model, kind, check, attempts=3)
    try:
        records, excluded = flow.to_scenes(numbered, meta, rights, spoken(True), tables.Store(folder, every=2))
        assert records.count() == 0
        assert {(r.book_id, r.reason) for r in excluded.collect()} == {("11", "unlabelled"), ("12", "unlabelled"), ("13", "rights")}
        calls = len(open(log).readlines())
        records, excluded = flow.to_scenes(numbered, meta, rights, spoken(False), tables.Store(folder, every=2))
    finally:
        flow.answered = hooked
    covered = {(r.book_id, i) for r in records.collect() for i in range(r.start_paragraph_index, r.end_paragraph_index + 1)}
    assert covered == {(b, i) for b in ("11", "12") for i in range(300)}
    assert len(open(log).readlines()) - calls == 4  # the two chunks that had failed, each told once what was missing
    assert ("13", "rights") in {(r.book_id, r.reason) for r in excluded.collect()}
    again, _ = flow.to_scenes(numbered, meta, rights, spoken(True), tables.Store(folder), done=records.select("book_id").distinct())
    assert again.count() == records.count()
    status = tables.marked(spark.createDataFrame([], "book_id string, status string"), records)
    cleared, marks, n = flow.reset_books(records, status, tables.Store(folder), "tone", books=["11"])
    assert cleared.count() == records.count() and n == records.where("book_id = '11'").count() and [r.book_id for r in marks.collect()] == ["12"]


def test_checks_of_answers():
    payload = json.dumps({"indexed_paragraphs": [{"index": i} for i in (3, 4, 5)]})
    told = lambda *spans: json.dumps({"scenes_data": [{"start_paragraph_index": a, "end_paragraph_index": b} for a, b in spans]})
    assert gates.uncovered(payload, told((3, 4), (5, 5))) is None
    assert "left out: [4]" in gates.uncovered(payload, told((3, 3), (5, 5)))
    assert "not given: [6]" in gates.uncovered(payload, told((3, 6))) and "more than one range: [4]" in gates.uncovered(payload, told((3, 4), (4, 5)))
    assert gates.uncovered(payload, "[]") and gates.uncovered(payload, "{") and gates.uncovered(payload, told((3, 10**12)))
    scenes = json.dumps({"scenes": [{"index": 0}]})
    good = {"index": 0, "dominant_tone": "joy", "intensity": "low", "arc": "turn", "descriptors": list("abcde"), "summary": "s"}
    assert enrich.unfit(scenes, json.dumps({"items": [good]})) is None
    for change in ({"index": 1}, {"arc": "up"}, {"descriptors": ["a"]}, {"summary": " "}, {"dominant_tone": None}, {"descriptors": None}):
        assert enrich.unfit(scenes, json.dumps({"items": [good | change]}))
    assert enrich.unfit(scenes, json.dumps({"items": [good, good]})) and enrich.unfit(scenes, "")


def test_invalid_facets_are_named(spark):
    def model(payload, notes, warmth):
        return json.dumps({"items": [{"index": s["index"], "dominant_tone": "joy" if s["index"] else "odd", "intensity": "low", "arc": "turn", "descriptors": list("abcde"), "summary": "s"} for s in json.loads(payload)["scenes"]]})

    rows = [("1", 1, i, f"1-{i}", "t", None, "<p>x</p>") for i in range(3)]
    batches = spark.createDataFrame(rows, "book_id string, batch int, index int, scene_id string, scene_title string, chapter_title string, text_html string")
    found = {r.scene_id: r for r in enrich.ask(batches, model, None).collect()}
    assert found["1-0"].failure == "facets out of vocabulary" and found["1-0"].arc is None and found["1-1"].dominant_tone == "joy" and found["1-1"].failure is None
    refused = enrich.ask(batches, model, attempts=2).collect()
    assert len(refused) == 3 and all("dominant_tone" in r.failure and r.summary is None for r in refused)
    mute = enrich.ask(batches, lambda *a: "no", None).collect()
    assert all(r.failure == "the answer is not of the agreed form" for r in mute)


def test_stream_upserts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    batches = [[("a", 1, 1), ("b", 1, 1)], [("a", 3, 2), ("a", 2, 9), ("c", 1, 1)], [("a", 1, 7), ("d", 1, 1)]]  # the last a is late
    for batch in batches:
        spark.createDataFrame(batch, "k string, ts int, v int").coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a second start finds nothing new
            ingest.start(spark, source, "k string, ts int, v int", path, str(tmp_path / "mark"), ["k"], ["ts"]).awaitTermination()
    wanted = [("a", 2), ("b", 1), ("c", 1), ("d", 1)]
    read = lambda: sorted((r.k, r.v) for r in ingest.table(spark, path, "k string, ts int, v int", ["k"], ["ts"]).table().collect())
    assert read() == wanted
    ingest.upsert_into(path, ["k"], ["ts"])(spark.createDataFrame(batches[2], "k string, ts int, v int"), 2)  # the same batch again
    assert read() == wanted
