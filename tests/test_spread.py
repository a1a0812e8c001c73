"""Ordered work on groups larger than a task, with ranges and blocks of a few rows, against plain loops and the windows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import paragraphs, scenes, spread


def fold(sizes, limit, size=None):
    """(part of each item, size of the last part)"""
    parts, part = [], 0
    for x in sizes:
        if size is None or size + x > limit:
            part, size = part + 1, x
        else:
            size += x
        parts.append(part)
    return parts, size


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 13), min_size=1, max_size=25), st.integers(1, 10), st.integers(0, 24), st.integers(0, 12))
def test_functions_of_blocks(sizes, limit, cut, enter):
    cap = lambda s: limit + 1 if s > limit else s
    parts, size = fold(sizes, limit, cap(enter))
    whole = spread.transition(np.array(sizes), limit)
    assert [cap(spread.applied(whole, cap(enter), limit)[0]), spread.applied(whole, cap(enter), limit)[1]] == [cap(size), parts[-1]]
    if 0 < cut < len(sizes):
        both = spread.composed(spread.transition(np.array(sizes[:cut]), limit), spread.transition(np.array(sizes[cut:]), limit), limit)
        assert all(cap(spread.applied(both, s, limit)[0]) == cap(spread.applied(whole, s, limit)[0]) and spread.applied(both, s, limit)[1] == spread.applied(whole, s, limit)[1] for s in range(limit + 2))


def test_functions_stay_small():
    f = spread.transition(np.full(8192, 100), 3000)
    for _ in range(50):
        f = spread.composed(f, spread.transition(np.full(8192, 100), 3000), 3000)
    assert len(f) <= 32


@pytest.fixture(scope="module")
def books(spark):
    r = random.Random(9)
    rows = [("hot", i * 3, r.choice([0, 1, 5, 30, 200])) for i in range(3000)] + [(f"b{b}", i, r.randrange(40)) for b in range(20) for i in range(r.randrange(1, 60))]
    rows += [(None, i, 7) for i in range(50)] + [("large", 1, 500), ("large", 2, 0), ("large", 3, 500)]
    return spark.createDataFrame(r.sample(rows, len(rows)), "book_id string, idx int, n int"), rows


@pytest.mark.parametrize("ranges, block, fan", [(100, 7, 2), (700, 64, 3), (10**6, 8192, 256)])
def test_packing_of_large_groups(books, ranges, block, fan):
    frame, rows = books
    found = spread.packed(frame, "book_id", "idx", F.col("n"), 100, ranges, block, fan)
    wanted = set()
    for book in {b for b, *_ in rows}:
        own = sorted((i, n) for b, i, n in rows if b == book)
        parts = fold([n for _, n in own], 100)[0]
        wanted |= {(book, i, p, parts[-1]) for (i, _), p in zip(own, parts)}
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(rows)
    if block == 64:
        same = paragraphs.packed(frame.where("book_id is not null"), ["book_id"], "idx", F.col("n"), 100)
        assert {tuple(r) for r in same.collect()} == {w for w in wanted if w[0] is not None}


def test_nothing_to_pack(books):
    assert spread.packed(books[0].limit(0), "book_id", "idx", F.col("n"), 100).isEmpty()


@pytest.mark.parametrize("ranges", [13, 400])
def test_numbers_and_islands(spark, books, ranges):
    frame, rows = books
    found = spread.numbered(frame, "book_id", "idx", range_rows=ranges)
    wanted = set()
    for book in {b for b, *_ in rows}:
        wanted |= {(book, i, n, k) for k, (i, n) in enumerate(sorted((i, n) for b, i, n in rows if b == book))}
    assert {tuple(r) for r in found.collect()} == wanted
    labels = frame.where("book_id is not null").select(
        "book_id", F.struct(F.floor(F.col("idx") / 10).alias("chunk"), "idx").alias("ord"),
        F.col("idx").cast("long").alias("start_paragraph_index"), (F.col("idx") + F.col("n") % 3).cast("long").alias("end_paragraph_index"),
        F.when(F.col("n") != 7, F.col("n") != 5).alias("open_start_index"), (F.col("n") != 30).alias("open_end_index"), F.concat(F.lit("t"), "idx").alias("title"),
    )
    plain = scenes.linked(scenes.stitched(labels))
    spread_ = spread.linked(spread.stitched(labels, ranges))
    same = lambda df: sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    assert same(spread_) == same(plain)
    longest = plain.where("book_id = 'hot'").agg(F.max(F.col("end") - F.col("start"))).first()[0]
    assert longest > 13 * 3 if ranges == 13 else True  # islands that run over several ranges


def test_scene_text_by_bins(spark):
    r = random.Random(1)
    texts = {(b, i): f" text {b} {i} " for b in range(3) for i in range(2000) if i % 7}
    held = spark.createDataFrame([(str(b), i, t) for (b, i), t in texts.items()], "book_id string, idx int, text string")
    ranges = [(str(r.randrange(4)), k, s := r.randrange(2100), s + r.choice([-1, 0, 3, 255, 256, 1500, 10**12])) for k in range(60)]
    found = scenes.scene_text(spark.createDataFrame(ranges, "book_id string, scene int, start long, end long"), held)
    wanted = {}
    for b, k, s, e in ranges:
        inside = [texts[int(b), i].strip() for i in range(s, min(e, 2000) + 1) if (int(b), i) in texts]
        wanted[b, k] = ("<p>" + "</p><p>".join(inside) + "</p>", sum(len(t.split()) for t in inside))
    assert {(x.book_id, x.scene): (x.text_html, x.word_count) for x in found.collect()} == wanted
