"""Manifest, quality rules and lexical search against plain versions on awkward tables."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm import embedding_dedup, lexical_search, manifest, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, slot int, f string, row string, quality string"


def frame(spark, rows):
    """Documents with further columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", 1, "f", "r", "q") for i, t, lang, s in rows], DOCS)


def sentence(r, n):
    return " ".join(r.choice(["ab", "Cde", "fghi", "été", "k9", "LM", "日本", "x#y", "die"]) + r.choice("aeiou") * r.randrange(3) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(i, sentence(r, r.randrange(1, 150)), r.choice(["en", "de", "fr", None, ""]), r.choice(["h1", "h2", None])) for i in range(70)]
    r.shuffle(out)
    out += [(500, out[3][1], "en", "h1")] * 3 + [(501 + i, out[3][1], "en", "h1") for i in range(5)]  # repeated rows and copies
    out += [(7, "other text of one id", "en", "h1"), (None, "no id", "de", None), (None, None, None, None), (600, "", "en", "h2")]
    out += [(601, " \n\t\r\x0b\x0c ", "fr", "h2"), (602, "a b   é", "xx", "h2"), (603, sentence(r, 60_000), "en", "h1")]
    return out


# -- manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """(top, for each leaf its siblings level by level as (left, right))."""
    level, of, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, node in enumerate(of):
            run = node - node % fanout
            proofs[leaf].append(("".join(level[run:node]), "".join(level[node + 1 : run + fanout])))
        level = [digest(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        of = [node // fanout for node in of]
    return level[0], proofs


def plain_manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        h = digest(*map(field, (i, source, lang, len(t) if t is not None else None, t)))
        leaves[lang].append(((i is not None, i or 0), h, i))
    order = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    found = {lang: tree([h for _, h, _ in sorted(leaves[lang])], fanout) for lang in order}
    root, upper = tree([found[lang][0] for lang in order], fanout) if order else (None, [])
    out = []
    for lang, last in zip(order, upper):
        top, proofs = found[lang]
        for slot, ((_, h, i), proof) in enumerate(zip(sorted(leaves[lang]), proofs)):
            out.append((i, h, slot, len(leaves[lang]), top, root, tuple(proof + last)))
    return out


@pytest.mark.parametrize("fanout, levels, part", [(2, 10, 200_000), (2, 2, 9), (3, 1, 5)])
def test_manifest(spark, rows, monkeypatch, fanout, levels, part):
    monkeypatch.setattr(manifest, "RANGE_ROWS", part)
    found = manifest.manifest(frame(spark, rows), fanout=fanout, levels=levels, keep={"lang": F.col("lang")})
    found = found.withColumn("again", manifest.folded(F.col("leaf"), F.col("proof"))).withColumn("sum", manifest.siblings(F.col("proof")))
    told = found.collect()
    wanted = plain_manifest(rows, fanout)
    key = lambda x: tuple(map(str, x))
    names = ["doc_id", "leaf", "slot", "n_leaves", "subroot", "root"]
    assert sorted(((*[r[n] for n in names], tuple((s.left, s.right) for s in r.proof)) for r in told), key=key) == sorted(wanted, key=key)
    assert all(r.again == r.root for r in told)
    assert all(r["sum"] == digest(*[s.left + s.right for s in r.proof]) for r in told)
    one = told[0]
    assert digest("other") not in {s.left for s in one.proof}
    forged = found.withColumn("bad", manifest.folded(F.lit(digest("forged")), F.col("proof")))
    assert forged.where("bad = root").isEmpty()


def test_manifest_edges(spark, rows):
    assert manifest.manifest(frame(spark, [])).isEmpty()
    one = manifest.manifest(frame(spark, [(1, "a", "en", "s")])).first()
    assert one.leaf == one.subroot == one.root == digest("1:1", "1:s", "2:en", "1:1", "1:a") and one.proof == []
    with pytest.raises(ValueError, match="taken"):
        manifest.manifest(frame(spark, rows), keep={"leaf": F.col("leaf")})


# -- quality rules


def plain_quality(rows, max_docs, min_words, min_left):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    had, out = defaultdict(set), []
    for _, t, _, host in rows:
        for line in (t or "").split("\n"):
            if words(line):
                had[host, " ".join(words(lower(line)))].add(t)
    for i, t, _, host in rows:
        t = t or ""
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        common = [n for n in (" ".join(words(lower(x))) for x in lines) if len(had[host, n]) > max_docs]
        failed = len(w) < min_words or 2 * len(covered) > len(w)
        left = len(w) - sum(len(words(x)) for x in common)
        kept = not failed and left >= min_words and left >= min_left * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, kept, len(set(common)), left))
    return out


@pytest.fixture(scope="module")
def lined(rows):
    r = random.Random(3)
    shared = [sentence(r, n) for n in (3, 12, 40)]
    out = [(i, "\n".join([t, shared[0], *([shared[1].upper()] if i % 2 else []), shared[0]]) if t else t, lang, h) for i, t, lang, h in rows[:60]]
    out += [(800 + i, f"{shared[2]}\n  {shared[1]} \n{i} alone", "en", "h1") for i in range(9)]
    out += [(900 + i, f"{shared[2]}\nof another host {i}", "en", "h9") for i in range(2)]
    out += [(950, "a b c a b c", "en", "h1"), (951, "one two three", "en", "h1"), (952, "a a a a", None, None)]
    return out + rows[60:]


@pytest.mark.parametrize("max_docs, min_words, min_left", [(25, 50, 0.3), (4, 20, 0.5), (1, 1, 0.0)])
def test_quality_rules(spark, lined, max_docs, min_words, min_left):
    docs = frame(spark, lined)
    found = quality_rules.screen(docs, max_docs=max_docs, min_words=min_words, min_left=min_left)
    wanted = plain_quality(lined, max_docs, min_words, min_left)
    assert sorted(map(str, (tuple(r) for r in found.select("doc_id", "quality.*").collect()))) == sorted(map(str, wanted))
    if max_docs == 4:
        assert any(x[8] and x[7] for x in wanted) and any(x[8] and not x[7] and not x[6] for x in wanted)
        kept = quality_rules.clean(docs, max_docs=max_docs, min_words=min_words, min_left=min_left)
        assert kept.columns == docs.columns
        told = sorted((str(r.doc_id), len(r.text.split(" ") if r.text else []) > 0) for r in kept.collect())
        assert told == sorted((str(x[0]), True) for x in wanted if x[7])
        lefts = {x[0]: x[9] for x in wanted if x[7]}
        for r in kept.collect():
            assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == lefts[r.doc_id]


def test_quality_of_nothing_and_of_slices(spark, monkeypatch):
    assert quality_rules.screen(frame(spark, [])).isEmpty()
    text = sentence(random.Random(1), 3000).encode()
    whole = quality_rules.repeated_words(text)
    monkeypatch.setattr(quality_rules, "SLICE", 7)
    assert quality_rules.repeated_words(text) == whole and whole[0] == len(text.split())


# -- lexical search


def plain_search(rows, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(cut(t))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for name, t in items:
        asked[name] |= set(cut(t))
    out = []
    for name, found in asked.items():
        scores = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in found if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(name, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("k, first, coordinates", [(10, 64, 65536), (3, 3, 65536), (4, 4, 5), (1, 1, 1)])
def test_lexical_search(spark, rows, k, first, coordinates):
    r = random.Random(4)
    items = [(i, sentence(r, r.randrange(1, 12))) for i in range(12)] + [(3, "k9 and more"), (50, None), (51, ""), (52, "nowhere at all"), (None, "DIE die")]
    items += [(60, rows[3][1])]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")
    found = lexical_search.search(frame(spark, rows), asked, k=k, first=first, coordinates=coordinates)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(x) for x in found.collect()))) == sorted(map(str, plain_search(rows, items, k)))


def test_lexical_search_of_nothing(spark, rows):
    asked = spark.createDataFrame([(1, "die")], "item_id long, text string")
    assert lexical_search.search(frame(spark, []), asked).isEmpty()
    assert lexical_search.search(frame(spark, rows), asked.limit(0)).isEmpty()


def test_terms_do_not_depend_on_slices(monkeypatch):
    text = sentence(random.Random(1), 3000).encode()
    whole = lexical_search.terms(text)
    monkeypatch.setattr(lexical_search, "SLICE", 5)
    assert lexical_search.terms(text) == whole and lexical_search.terms("É-a_B 9".encode()) == Counter(["É".encode(), b"a", b"b", b"9"])


# -- dense cells of embedding near-dedup


def test_forest_against_a_search():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, m = r.integers(1, 30, 2)
        hit, forest = r.random((n, m)) < r.choice([0.02, 0.05, 0.1, 0.5]), embedding_dedup._Forest(n + m)
        for at in range(0, n, 7):
            forest.link(hit[at : at + 7], np.arange(n)[at : at + 7], n + np.arange(m))
        least, before = np.arange(n + m), None
        while before is None or (before != least).any():
            before = least.copy()
            for i, j in zip(*np.nonzero(hit)):
                least[i] = least[n + j] = min(least[i], least[n + j])
        assert (least == forest.up).all()


def test_a_dense_block_keeps_no_pairs():
    r = np.random.default_rng(2)
    x = r.normal(size=16) + r.normal(size=(3000, 16)) * 0.02
    block = pd.DataFrame({"side": 0, "same": True, "node": np.arange(3000) + 7, "v": list(x), "n": 1})
    found = embedding_dedup._compare(0.93, 256)(block)
    assert set(found["peer"]) == {7} and (found["links"] == 2999).all()


# -- the queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_quality_rules", "op13_lexical_search"])
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    from quire.llm.queries import ORACLE_SQL, QUERIES

    data, db = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = QUERIES[name](spark, data)
    wanted = db.sql(f"select {', '.join(found.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, wanted))
