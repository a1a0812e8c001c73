"""The pipeline against the stages' own rules, applied in plain Python."""

import os
import random
import re

import corpus_pipeline
from test_llm_operators import DOCS, frame, plain_fingerprint, plain_hits, repeats_of, sentence


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "suffix_dedup", "decontamination", "packing"]


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    bench = [(i, sentence(r, 20)) for i in range(5)]
    texts = [sentence(r, r.randrange(30, 200)) for _ in range(30)]
    passage = sentence(r, 120)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(50 + i, texts[2], "en", "s1") for i in range(3)]
    rows += [(60 + i, f"{sentence(r, 40)} {passage} {sentence(r, 40)}", "fr", "s2") for i in range(3)]
    rows += [(70, f"{sentence(r, 20)} {bench[1][1]}", "en", "s0"), (80, "12 34", "en", "s0"), (81, None, "en", "s0")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))

    kept = [(i, t) for i, t, _, _ in rows if t and re.search(r"[^\W\d_]", t)]
    prints = [plain_fingerprint(t) for _, t in kept]
    up = list(range(len(kept)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[max(top(i), top(j))] = min(top(i), top(j))
    kept = [k for i, k in enumerate(kept) if top(i) == i]
    removed = list(repeats_of([t.encode() for _, t in kept], 400))
    assert any(n for _, n, _, _ in removed)
    sizes = {}
    from collections import Counter

    seen = Counter(t[p : p + 400] for _, t in kept for p in range(len(t) - 399))
    for i, t in kept:
        hit = [False] * len(t)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                hit[p : p + 400] = [True] * 400
        left = "".join(c for c, h in zip(t, hit) if not h)
        n, hits, _, _ = plain_hits(left, bench)
        if not (hits and 20 * hits >= n) and left.split():
            sizes[i] = len(left.split())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for p in found:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.n_units
        assert len(p.text.split()) == p.n_units
    whole = {i: " ".join(x.text for x in sorted(found, key=lambda x: x.start) if x.doc_id == i) for i in got}
    uncut = {i: t for i, t in kept if i < 50 and i != 2}
    assert all(whole[i].split() == t.split() for i, t in uncut.items() if sizes.get(i) == len(t.split()))
    assert got == sizes and 70 not in got and 80 not in got and 61 in got


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    os.makedirs(tmp_path, exist_ok=True)
    spark.createDataFrame([(1, "some words of a test")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    for rows in ([], [(1, "words", "en", "s"), (1, "words", "en", "s"), (None, None, None, None)]):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns == [c.split()[0] for c in DOCS.split(", ")]
            assert out.count() <= len(rows)
