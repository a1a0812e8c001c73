"""Shelves of whole books: what goes in comes out, and only what is missing is made."""

import glob
import os

from pyspark.sql import functions as F

from quire.sources import books

CHUNKS = f"book_id string, {books.CHUNK}"


def metadata_of(spark, *rows):
    return spark.createDataFrame([(i, f"link/{i}", author, None, title, subjects, None, "en") for i, author, title, subjects in rows], books.METADATA)


def chunk(book, at, heading="H", context=(), texts=("t",)):
    return book, at, 0, heading, 1, 1, list(context), [(at * 10 + i, t) for i, t in enumerate(texts)]


def taken(found):
    metadata, chunks = found
    return sorted(metadata.collect(), key=str), sorted(chunks.collect(), key=str)


def test_books_come_back_as_they_went_in(spark, tmp_path):
    odd = 'é "quoted"\n\ttab \\ back line'
    metadata = metadata_of(spark, ("1", odd, None, ["b", "é"]), ("007", None, "", []), ("none", "A", "no chunks", None))
    chunks = spark.createDataFrame(
        [chunk("1", 0, None, texts=[odd, ""]), chunk("1", 1, "", [(3, odd)]), chunk("007", 0, texts=[]), chunk("stray", 0)], CHUNKS
    )
    books.shelve(metadata, chunks, str(tmp_path / "shelf"))
    found = books.shelf(spark, str(tmp_path / "shelf"))
    assert found[0].columns == metadata.columns and found[1].columns == chunks.columns
    assert taken(found) == taken((metadata, chunks.where("book_id <> 'stray'")))
    assert taken(books.shelf(spark, str(tmp_path / "empty"))) == ([], [])


def test_the_last_whole_making_counts(spark, tmp_path):
    path = str(tmp_path / "shelf")
    for title in ("first", "second"):
        chunks = spark.createDataFrame([chunk("1", i, title) for i in range(3)] + [chunk("2", 0, title)], CHUNKS)
        books.shelve(metadata_of(spark, ("1", None, title, []), ("2", None, title, []), ("2", None, title, [])), chunks, path)
    last = sorted(glob.glob(f"{path}/made=*"))[-1]
    for name in glob.glob(f"{last}/*.json"):  # one chunk of the first book is damaged
        text = open(name, encoding="utf-8").read()
        lines = [x[:20] if '"book_id":"1"' in x and '"chunk_index":1' in x else x for x in text.splitlines()]
        open(name, "w", encoding="utf-8").write("".join(x + "\n" for x in lines))
    for name in glob.glob(f"{last}/.*.crc"):
        os.remove(name)
    metadata, chunks = taken(books.shelf(spark, path))
    assert {r.ID: r.Title for r in metadata} == {"1": "first", "2": "second"}
    assert [(r.book_id, r.chunk_index, r.chapter_heading) for r in chunks] == [("1", i, "first") for i in range(3)] + [("2", 0, "second")]


def test_only_missing_books_are_made(spark, tmp_path):
    path, asked = str(tmp_path / "shelf"), []

    def make(ids):
        own = sorted(r.book_id for r in ids.collect())
        asked.append(own)
        return metadata_of(spark, *[(b, None, "t", []) for b in own if b != "unknown"]), spark.createDataFrame([chunk(b, 0) for b in own], CHUNKS)

    ids = lambda *names: spark.createDataFrame([(b,) for b in names], "book_id string")
    books.recalled(ids("a", "b", "b"), path, make)
    metadata, chunks = books.recalled(ids("a", "c"), path, make)
    assert asked == [["a", "b"], ["c"]]
    assert {r.ID for r in metadata.collect()} == {r.book_id for r in chunks.collect()} == {"a", "c"}
    books.recalled(ids("a", "b", "c"), path, make)
    assert len(asked) == 2
    # a run that broke after the chunks: nothing of it is taken, and the book is asked for again
    spark.createDataFrame([chunk("d", 0)], CHUNKS).select("book_id", F.struct("chunk_index").alias("chunk")).write.json(f"{path}/made=1")
    assert books.recalled(ids("d"), path, make)[1].count() == 1 and asked[-1] == ["d"]
