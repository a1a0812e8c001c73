"""Each operator against a plain brute-force version on small, awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import (
    decontaminate,
    embedding_dedup,
    language_id,
    license_scan,
    packing,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)
from quire.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, found string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, lang, s, len(t) if t is not None else None, 1, "x", "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(r, n, words="ab cde fghi jk lmn opq rst uvw xyz die und le".split()):
    return " ".join(r.choice(words) + r.choice("aeiou") * r.randrange(3) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [sentence(r, r.randrange(1, 300)) for _ in range(25)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[3], "en", "s0") for i in range(6)]  # copies
    for i in range(6):  # near copies: one word changed
        w = base[5].split()
        w[len(w) // 2] = f"new{i}"
        out.append((200 + i, " ".join(w), "fr", None))
    passage = sentence(r, 130)
    out += [(300 + i, f"{sentence(r, 20)} {passage} {sentence(r, 30)}", "de", "s1") for i in range(4)]
    out += [(400, None, None, None), (401, "", "en", "s1"), (402, " \n\t ", "en", "s1"), (403, "é" * 500, "fr", "s2")]
    out += [(404, "a" * 1500, "en", "s2"), (405, "ab" * 700, "en", "s2"), (None, "no id here", "en", "s2"), (7, base[7], "en", "s1")]
    out += [(500, sentence(r, 6000), "en", "s0"), (501, "Hé! <|endoftext|> O'Neil x", "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


def key(x):
    return tuple((v is not None, v) for v in x)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (APACHE, ["apache2-notice"], ["Apache-2.0"], False), (MIT, ["mit-text", "mit-named"], ["MIT"], False),
    (BSD3, ["bsd3-text"], ["BSD-3-Clause"], False), (GPL3, ["gpl3-notice"], ["GPL-3.0-or-later"], True),
    (GPL2, ["gpl2-notice"], ["GPL-2.0-or-later"], True), (MPL2, ["mpl2-header"], ["MPL-2.0"], True),
]


def test_published_licence_notices(spark):
    """Wrapped as published, behind comment signs, with DOS line ends, and each paragraph on one line."""
    rows, wanted = [], {}
    for n, (text, *verdict) in enumerate(NOTICES):
        flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        hashes = "\n".join(f"# {x}".rstrip() for x in text.split("\n"))
        stars = "/*\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n")) + "\n */\nint main"
        for k, t in enumerate([text, flat, hashes, stars, text.replace("\n", "\r\n"), f"Some words first.\n\n{text}\n\nand more"]):
            rows.append((n * 10 + k, t, None, None))
            wanted[n * 10 + k] = tuple(verdict)
    found = license_scan.scan(frame(spark, rows)).select("doc_id", "license.*").collect()
    assert {r.doc_id: (r.rules, r.licenses, r.restricted) for r in found} == wanted


def test_license_sequences(spark):
    texts = [
        "Hello. Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.",
        "ALL RIGHTS RESERVED!\nSome words.\nNo part of this work may be reproduced without permission",
        "No part of this work may be reproduced without permission. All rights reserved.",
        "Released under the MIT License. Released under the MIT License.",
        "unreleased under the MIT License", None, "", "...", "Licensed under CC BY-NC 4.0." * 1,
        "a line\nReleased under the MIT License\nanother line", "x \x01All rights reserved\x02.",
        "\n" * 100_000 + "All rights\nreserved" + " \n.\n" * 50_000,
    ]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).withColumn("license", F.lit("own")).withColumn("_q_ids", F.lit(1))
    found = license_scan.scan(docs).orderBy("doc_id")
    assert found.columns == docs.columns
    got = [(r.license.rules, r.license.licenses, r.license.restricted) for r in found.collect()]
    assert got[0] == (["apache2-header-short"], ["Apache-2.0"], False)
    assert got[1] == (["reserved-strict"], ["Proprietary"], True)
    assert got[2] == (["reserved"], ["Proprietary"], True)
    assert got[3] == (["mit-line"], ["MIT"], False)
    assert got[4:8] == [([], [], False)] * 4
    assert got[8] == (["ccbync-line"], ["CC-BY-NC-4.0"], True)
    assert got[9] == got[3] and got[10] == ([], [], False) and got[11] == got[2]
    assert found.where("doc_id = 3").first().license.sentences == ["mit-short", "mit-short"]
    assert "Python" not in found._jdf.queryExecution().toString()
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, [(1, "All rights reserved.", None, None)]), rules=[], wordings=[]).first().license.rules == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_token_counts(spark, docs, rows, tmp_path, name):
    path = public_tokenizers.path(name)
    count = token_counts.counter(path)
    wanted = []
    for i, t, _, _ in rows:
        n = count([t or ""])[0]
        wanted.append((i, len((t or "").encode()), n, n > 512))
    for _ in range(2):  # the second run only reads the cache
        same(token_counts.token_counts(docs, path, str(tmp_path)).collect(), wanted)
    cached = spark.read.parquet(str(tmp_path))
    half = str(tmp_path / "half")
    token_counts.fill_cache(docs.where("doc_id % 2 = 0"), path, half)
    held = spark.read.parquet(half).count()
    token_counts.fill_cache(docs.where("doc_id % 2 = 0"), path, half)  # all hits: nothing is appended
    assert 0 < held == spark.read.parquet(half).count() < cached.count()
    spark.read.parquet(half).write.mode("append").partitionBy("tokenizer").parquet(half + "-twice")
    spark.read.parquet(half).write.mode("append").partitionBy("tokenizer").parquet(half + "-twice")  # two writers side by side
    for folder in (half, half + "-twice"):
        same(token_counts.token_counts(docs, path, folder).collect(), wanted)
    missing = {t or "" for i, t, _, _ in rows} - {t or "" for i, t, _, _ in rows if i is not None and i % 2 == 0}
    assert spark.read.parquet(half).count() == held + len(missing)
    assert cached.count() == len({t or "" for _, t, _, _ in rows})
    assert token_counts.token_counts(frame(spark, []), path, str(tmp_path / "new")).count() == 0


def repeats_of(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                hit[p : p + length] = True
        kept = bytes(b for b, h in zip(t, hit) if not h)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        yield len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark, docs, rows):
    found = suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    wanted = repeats_of([(t or "").encode() for _, t, _, _ in rows], 400)
    same(found.collect(), [(r[0], *w) for r, w in zip(rows, wanted)])
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_of_short_strings_over_many_texts(spark):
    r = random.Random(1)
    words = ["ab", "cd", "ef", "longer"]
    rows = [(i, sentence(r, 60, words), None, None) for i in range(120)]
    found = suffix_dedup.dedup(frame(spark, rows).repartition(5), length=60, gram=20)
    wanted = repeats_of([t.encode() for _, t, _, _ in rows], 60)
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), [(x[0], *w) for x, w in zip(rows, wanted)])


def test_suffix_dedup_with_very_many_boundaries(spark, docs, rows, monkeypatch):
    """Buckets of a few suffixes: equal ones and groups of one core lie on both sides of most boundaries."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    r = random.Random(13)
    texts = [sentence(r, 60, ["ab", "cd", "ef", "longer"]) for _ in range(30)] + ["xy" * 300, "z" * 300, "a b " * 90]
    texts += [t[:150] + "#" + t[150:] for t in texts[:6]]
    found = suffix_dedup.dedup(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(3), length=60, gram=20)
    wanted = repeats_of([t.encode() for t in texts], 60)
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), [(i, *w) for i, w in enumerate(wanted)])


def test_suffix_dedup_counts_repeated_words(spark, docs, rows):
    found = suffix_dedup.dedup(docs, words=51)
    assert found.select("doc_id", "n_removed").exceptAll(suffix_dedup.dedup(docs).select("doc_id", "n_removed")).isEmpty()
    whole = [(t or "").encode().split() for _, t, _, _ in rows]
    seen = Counter(tuple(w[p : p + 51]) for w in whole for p in range(len(w) - 50))
    wanted = []
    for (i, _, _, _), w in zip(rows, whole):
        hit = [False] * len(w)
        for p in range(len(w) - 50):
            if seen[tuple(w[p : p + 51])] > 1:
                hit[p : p + 51] = [True] * 51
        wanted.append((i, sum(hit)))
    same(found.select("doc_id", "n_repeated_words").collect(), wanted)
    texts = {i: t for i, t, _, _ in rows}
    for x in found.where("doc_id >= 300 and doc_id < 310").collect():
        cut = b" ".join(texts[x.doc_id].encode()[s.start : s.end] for s in x.repeated)
        assert len(cut.split()) == x.n_repeated_words > 0


def test_word_digests_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(2)
    data = (sentence(r, 500) + " " + "q" * 900 + "\tend").encode()
    whole = suffix_dedup.Words(data)
    assert [data[a:b] for a, b in zip(whole.starts, whole.ends)] == data.split()
    assert len(set(whole.values.tolist())) == len(set(data.split()))
    monkeypatch.setattr(suffix_dedup, "STEP", 100)
    assert (suffix_dedup.Words(data).values == whole.values).all()


def test_anchors_do_not_depend_on_steps(monkeypatch):
    r = random.Random(2)
    data = sentence(r, 3000).encode() + b"z" * 3000
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "STEP", 1000)
    assert (suffix_dedup.anchors(data) == whole).all()


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    words = r.integers(-3, 3, (5000, 4))
    order = suffix_dedup.multikey_quicksort(words, small=8)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all()


def test_cut_keeps_rows_and_columns(spark, docs, rows):
    found = suffix_dedup.cut(docs)
    assert found.columns == docs.columns and found.count() == len(rows)
    left = {r.doc_id: r.text for r in found.collect()}
    assert left[100] == "" or len(rows[3][1]) < 400
    assert left[400] is None and left[500] == next(t for i, t, _, _ in rows if i == 500)


def test_cut_by_words_against_brute_force(spark):
    """Passages of 51 and more short words, which are under 400 bytes."""
    r = random.Random(4)
    short = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join(r.choice(short) for _ in range(r.randrange(0, 120))) for _ in range(40)]
    exact, under = (" ".join(r.choice(short) for _ in range(n)) for n in (51, 50))
    assert len(exact) < 400
    texts += [f"left{i} {under}\tright{i}" for i in range(3)]
    texts += [f"{texts[i]} left{i} {exact if i % 2 else exact.replace(' ', chr(10))} right{i} {texts[i + 9]}" for i in range(8)]
    texts += ["x y " * 40, None, "", " \n", "é " * 60, exact, f" {exact}\n"]
    found = suffix_dedup.cut(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(4), words=51)
    got = {x.doc_id: x.text for x in found.collect()}
    whole = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[p : p + 51]) for w in whole for p in range(len(w) - 50))
    cut = 0
    for i, w in enumerate(whole):
        hit = [False] * len(w)
        for p in range(len(w) - 50):
            if seen[tuple(w[p : p + 51])] > 1:
                hit[p : p + 51] = [True] * 51
        cut += any(hit)
        assert (got[i] or "").split() == [x for x, h in zip(w, hit) if not h], i
    assert cut >= 12 and got[41] == texts[41] and len(got) == len(texts)


def test_toxicity_finds_held_out_words(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = sentence(r, r.randrange(5, 60)).split()
        if i % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["vileword", "nastyword"]))
        rows.append((i, " ".join(words), r.choice(["en", "fr"]), "s"))
        labels.append((i, 0, int(i % 4 == 0)))
    rows += [(900, None, None, None), (901, "", "en", None), (None, "x", "en", None)]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    fitted = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    found = toxicity.score(docs, fitted)
    assert set(found.columns) == {*docs.columns, "toxicity"}
    got = {x.doc_id: x.toxicity.score for x in found.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert 0 <= got[900] == got[901] <= 1
    whole, parts = fitted[0], toxicity.hashed_words("ab cd vileword " * 9, fitted[0].buckets)
    one = whole.score(parts)
    old, toxicity.PIECE = toxicity.PIECE, 4
    assert whole.score(parts) == pytest.approx(one, abs=1e-6)
    toxicity.PIECE = old
    empty = toxicity.fit(docs, marks.limit(0))
    scores = {x.toxicity.score for x in toxicity.score(docs, empty).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    clash = docs.withColumn("toxicity", F.lit("own")).withColumn("_q_limit", F.lit(1))
    again = toxicity.score(clash.union(clash), fitted)
    assert again.columns == clash.columns and again.count() == 2 * len(rows) and again.first()["_q_limit"] == 1
    # long labelled texts are passed over, whatever their place; a short bound leaves the short ones
    long = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat("text", 3000)).otherwise(F.col("text")))
    part = toxicity.score(docs, toxicity.fit(long, marks.where(~toxicity.held_out())))
    got = {x.doc_id: x.toxicity.score for x in part.collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95


def test_toxicity_learns_from_all_labelled_texts(spark):
    """Long toxic texts that no bound leaves out, several tasks, and words that only one of them has."""
    r = random.Random(8)
    rows = [(i, sentence(r, 30) + (" vileword" if i % 3 == 0 else ""), "en", "s") for i in range(300)]
    long = [(i, (t + " ") * 200 if i % 3 == 0 else t, x, y) for i, t, x, y in rows]
    assert all(len(t) > 16_000 for i, t, _, _ in long if i % 3 == 0)
    marks = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    network, limits = toxicity.fit(frame(spark, long), marks)
    found = {x.doc_id: x.toxicity.flagged for x in toxicity.score(frame(spark, rows), (network, limits)).collect()}
    assert set(limits) == {"en"} and np.mean([found[i] == (i % 3 == 0) for i in found]) > 0.95
    ids = toxicity.hashed_words(long[0][1], network.buckets)
    once = toxicity.windows_once(ids, 3)
    assert len(once) < 50 and network.score(once) == pytest.approx(network.score(ids), abs=1e-6)
    mixed = toxicity.hashed_words(" ".join(r.choice("abcde") + r.choice("xy") for _ in range(5000)), network.buckets)
    assert network.score(toxicity.windows_once(mixed, 3)) == pytest.approx(network.score(mixed), abs=1e-6)
    shapes = [(len(mixed), 1), (0, 0), (40, 1)]
    whole = network.gradients([mixed[:n] for n, _ in shapes], np.array([y for _, y in shapes]))
    old, toxicity.PIECE = toxicity.PIECE, 7
    parts = network.gradients([toxicity.windows_once(mixed[:n], 3) for n, _ in shapes], np.array([y for _, y in shapes]))
    toxicity.PIECE = old
    assert parts[0] == pytest.approx(whole[0], abs=1e-5) and np.allclose(parts[1][-2], whole[1][-2], atol=1e-5)
    tasks = [(int(n % 2), 0, [n % 7, 8 + k, 9] * 3) for k in range(3) for n in range(40)]
    table = spark.createDataFrame(tasks, "label int, part int, ids array<int>").repartitionByRange(3, F.col("ids")[1])
    net = toxicity.Network(buckets=16)
    was = net.emb.copy()
    toxicity._pass_over(table, {-1: net}, {0: 1.0, 1: 1.0}, 1, 0.01)
    assert set(np.flatnonzero((net.emb != was).any(axis=1))) == set(range(11)) - {7}


def test_network_against_plain_loops_and_numeric_gradients():
    net = toxicity.Network(buckets=50, dim=3, widths=(1, 3), filters=2)
    for name in ("emb", "bias", "top", "base"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.conv = [c.astype(np.float64) for c in net.conv]
    net.bias += 0.3
    texts = [toxicity.hashed_words(t, 50) for t in ("a bc def", "", "one two three four five six", "x")]
    for ids in texts:
        x = [sum(net.emb[b] for b in row) for row in ids] or [np.zeros(3)]
        x += [np.zeros(3)] * 2
        hidden = []
        for c in net.conv:
            for f in range(2):
                values = [sum(x[i + j] @ c[j][:, f] for j in range(len(c))) for i in range(max(1, len(ids)))]
                hidden.append(max(0.0, max(values) + net.bias[len(hidden)]))
        z = np.dot(hidden, net.top) + net.base[0]
        assert net.score(ids) == pytest.approx(1 / (1 + np.exp(-z)))
    y = np.array([1.0, 0.0, 1.0, 0.0])
    _, grads = net.gradients(texts, y)
    for p, g in zip(net.parameters(), grads):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 20)]:
            was = p[at]
            p[at] = was + 1e-6
            up = net.gradients(texts, y)[0]
            p[at] = was - 1e-6
            down = net.gradients(texts, y)[0]
            p[at] = was
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_thresholds_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        toxic, clean = r.random(7).round(1), r.random(9).round(1)
        t = toxicity.threshold(toxic, clean)
        best = max((toxic >= x).mean() + (clean < x).mean() for x in np.linspace(-0.01, 1.01, 500))
        assert (toxic >= t).mean() + (clean < t).mean() == pytest.approx(best)


def plain_best_fit(pieces, capacity, per_source):
    bins, chosen = [], []
    for size, source, cluster in pieces:
        fits = [
            (capacity - sum(p[0] for p in b), i)
            for i, b in enumerate(bins)
            if sum(p[0] for p in b) + size <= capacity
            and all(p[2] != cluster or cluster < 0 for p in b)
            and (source < 0 or sum(p[1] == source for p in b) < per_source)
        ]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((size, source, cluster))
        chosen.append(i)
    return chosen


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_a_scan(seed):
    r = random.Random(seed)
    pieces = [(r.randrange(1, 60), r.randrange(-1, 4), r.randrange(-1, 30)) for _ in range(200)]
    assert packing.best_fit(pieces, 60, 2) == plain_best_fit(pieces, 60, 2)


def test_packing(spark, docs, rows):
    found = packing.pack(docs, capacity=256, per_source=2, units_per_shard=3000).collect()
    units = Counter()
    for p in found:
        units[p.doc_id] += p.n_units
    wanted = Counter()
    for i, t, _, _ in rows:
        wanted[i] += len((t or "").encode().split())  # words end at ASCII white space
    assert units == +wanted
    texts = {i: b" ".join((t or "").lower().encode().split()) for i, t, _, _ in rows}
    bins = defaultdict(list)
    for p in found:
        bins[p.seq_shard, p.seq].append(p)
    for b in bins.values():
        assert sum(p.n_units for p in b) == 256 - b[0].residual <= 256
        assert sorted(p.slot for p in b) == list(range(len(b)))
        assert len({texts[p.doc_id] for p in b}) == len(b)
        assert all(n <= 2 for s, n in Counter(p.source for p in b).items() if s is not None)
    assert len({p.seq_shard for p in found}) > 1
    assert packing.pack(frame(spark, [])).count() == 0
    named = packing.pack(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), capacity=256)
    again = Counter()
    for p in named.collect():
        again[p.doc_id] += p.n_units
    assert again == Counter({f"d{i}" if i is not None else None: n for i, n in units.items()})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(4)
    texts = [sentence(r, 300), "x" * 300 + " y", "", None, " \n ", "one two", "A  b\tC d", "q " * 99]
    for size in (1, 3, 5):
        whole = [simhash._hashes(t, size).tolist() for t in texts]
        monkeypatch.setattr(simhash, "SLICE", 7)
        assert [simhash._hashes(t, size).tolist() for t in texts] == whole
        monkeypatch.undo()
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_very_long_texts(spark):
    """One text of 120,000 words among short ones, in every operator that reads texts."""
    r = random.Random(21)
    long = sentence(r, 120_000)
    rows = [(0, long, "en", "a"), (1, long + " and more", "en", "a"), (2, "short one", "en", "b"), (3, None, None, None)]
    docs = frame(spark, rows)
    assert license_scan.scan(docs).where("size(license.rules) = 0").count() == 4
    prints = {x.doc_id: x.fp for x in simhash.near_duplicates(docs).collect()}
    assert prints[0] == int(np.uint64(plain_fingerprint(long)).astype(np.int64))
    units = packing.pack(docs).groupBy("doc_id").agg(F.sum("n_units").alias("n"), F.max("n_units").alias("most")).collect()
    assert {x.doc_id: x.n for x in units} == {0: 120_000, 1: 120_002, 2: 2} and max(x.most for x in units) == 2048
    cut = {x.doc_id: x.n_removed for x in suffix_dedup.dedup(docs).collect()}
    assert cut[0] == len(long) and cut[1] == len(long) and cut[2] == 0
    items = spark.createDataFrame([(1, " ".join(long.split()[-20:]))], "item_id long, text string")
    hit = {x.doc_id: x.f.n_hit for x in decontaminate.scan(docs, items, out="f").collect()}
    assert hit == {0: 20, 1: 20, 2: 0, 3: 0}
    named = {x.doc_id: x.language.lang for x in language_id.identify(docs, frame(spark, [(9, sentence(r, 300), "en", "s")])).collect()}
    assert named == {0: "en", 1: "en", 2: "en", 3: "und"}
    path = public_tokenizers.path("byte_bpe_50k.json")
    import tempfile

    counts = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, path, tempfile.mkdtemp()).collect()}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    assert counts == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows}


def groups_of(n, linked):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def test_simhash(spark, docs, rows):
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    tops = groups_of(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    least = defaultdict(list)
    for r, top in zip(rows, tops):
        least[top].append(r[0])
    wanted = [(r[0], p - (1 << 64) if p >> 63 else p, min((x for x in least[t] if x is not None), default=None)) for r, p, t in zip(rows, prints, tops)]
    same(simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect(), wanted)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(tops))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_links_are_all_found(spark):
    r = random.Random(9)
    prints = set()
    for _ in range(60):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(4):
            y = x
            for b in r.sample(range(64), r.randrange(1, 5)):
                y ^= 1 << b
            prints.add(y)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    pairs = {frozenset(x) for x in found.collect()}
    m = (1 << 64) - 1
    wanted = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & m).count("1") <= 3}
    assert pairs == wanted


def test_texts_of_packed_pieces(spark):
    """Null, blank and long texts, an id with two texts, rows that repeat, null ids, a clashing column, an empty table."""
    texts = [(1, " a  b\tc d\n\ne f g "), (1, "other words of one id here"), (1, "other words of one id here"), (2, None), (3, " \n"), (None, "no id at all"), (4, "\u00e9\u00a0x " * 20)]
    docs = frame(spark, [(i, t, None, None) for i, t in texts]).withColumn("row_hash", F.lit("clash"))
    found = packing.pack_texts(docs, capacity=3).collect()
    assert [c for c in packing.pack_texts(docs, capacity=3).columns if c != "text"] == packing.pack(docs, capacity=3).columns
    want = []
    for i, t in texts:
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", t or "")]
        for p in range(0, len(words), 3):
            part = words[p : p + 3]
            want.append((i, p, len(part), t[part[0][0] : part[-1][1]]))
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
    assert order((x.doc_id, x.start, x.n_units, x.text) for x in found) == order(want)
    assert packing.pack_texts(frame(spark, [])).count() == 0


def test_candidates_that_are_apart(spark):
    """Two groups in one bucket, linked by one pair that neither neighbours nor leaders would meet."""
    r = random.Random(3)
    rows = [(100 * g + i, 1, g * 1000 + i, 100) for g in range(2) for i in range(40)]
    sketches = {n: simhash.sketch(np.unique(np.array([r.getrandbits(64) for _ in range(100)], np.uint64))) for n, *_ in rows}
    sketches[139] = sketches[39]
    nodes = spark.createDataFrame([(n, 5, k, sketches[n]) for n, _, _, k in rows], "node long, fp long, n long, sketch binary")
    joined = spark.createDataFrame([(100 * g + i, 100 * g) for g in range(2) for i in range(40)], "node long, root long")
    shared = spark.createDataFrame([(7, n) for n, *_ in rows], "bucket long, node long")
    none = spark.createDataFrame([], "src long, dst long")
    found = {(x.src, x.dst) for x in simhash._apart(nodes, joined, shared, none, 0.8).collect()}
    assert found == {(39, 139)}
    one = joined.withColumn("root", F.lit(0).cast("long"))
    assert simhash._apart(nodes, one, shared, none, 0.8).count() == 0


def test_sets_that_are_apart_meet_by_rare_shingles(spark):
    """A bucket with a large component and as many sets just too far from it: all pairs of similarity 0.8, few others."""
    r = random.Random(4)
    base = [r.getrandbits(62) for _ in range(146)]
    own, root = {}, {}
    for i in range(240):
        gone = 5 * r.randrange(3) if i < 120 else r.randrange(18, 30)
        own[i] = {*r.sample(base, 146 - gone), *(r.getrandbits(62) for _ in range(gone))}
        root[i] = 0 if i < 120 else i
    for i in range(120, 160):  # near to one of the component, to another outside it, or of another size
        near = sorted(own[i - 120 if i % 2 else i + 60])
        own[i] = {*r.sample(near, r.randrange(110, 147)), *(r.getrandbits(62) for _ in range(r.randrange(12)))}
    nodes = spark.createDataFrame([(i, 9, len(h)) for i, h in own.items()], "node long, fp long, n long")
    joined = spark.createDataFrame([x for x in root.items() if x[0] < 120], "node long, root long")
    shared = spark.createDataFrame([(7, i) for i in own], "bucket long, node long")
    hashes = spark.createDataFrame([(i, x) for i, h in own.items() for x in h], "node long, h long")
    none = spark.createDataFrame([], "src long, dst long")
    sets = lambda some: hashes.join(some, "node", "left_semi")
    pairs = [(i, j) for j in own for i in range(j) if root[i] != root[j]]
    alike = {(i, j) for i, j in pairs if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    found = {(x.src, x.dst) for x in simhash._apart(nodes, joined, shared, none, 0.8, sets).collect()}
    assert alike and alike <= found <= set(pairs)
    outer = {(i, j) for i, j in found if j >= 220}  # far from all others: these sets met 120 each before
    assert len(outer) <= 20, len(outer)
    same_root = joined.union(nodes.where("node >= 120").select("node", F.lit(0).cast("long")))
    assert simhash._apart(nodes, same_root, shared, none, 0.8, sets).count() == 0


def test_similar_texts_against_brute_force(spark):
    """Chains and a large group of edited copies; pairs of similarity 0.8 or more, and pairs just below."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return " ".join(w)

    texts = []
    for _ in range(60):
        base = " ".join(r.choice(vocabulary) for _ in range(r.randrange(40, 250)))
        texts += [base, edited(base, max(1, len(base.split()) // 50)), edited(base, len(base.split()) // 40 + 1)]
    base = " ".join(r.choice(vocabulary) for _ in range(150))
    texts += [edited(base, r.randrange(4)) for _ in range(150)]
    texts += [base.upper(), base.replace(" ", "\n"), None, "", " ", "one two", "One  two", "one three"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))})
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in alike:
        up[max(top(i), top(j))] = min(top(i), top(j))
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(4)
    groups = simhash.similar(docs, 0.8, shingle=5)
    root = {x.doc_id: x.component_id for x in groups.select("doc_id", "component_id").collect()}
    assert all(top(root[i]) == top(i) for i in root)  # no text is linked to one of another group
    found = sum(root[i] == root[j] for i, j in alike)
    assert found >= 0.995 * len(alike), (found, len(alike))
    fps = [simhash.fingerprint(t) for t in texts]
    assert any(bin(fps[i] ^ fps[j]).count("1") > 3 for i, j in alike)
    kept = {x.doc_id for x in simhash.keep_one(docs, shingle=5, similarity=0.8).collect()}
    assert kept == set(root.values())
    assert simhash.similar(frame(spark, []), 0.8, shingle=5).count() == 0
    print("recall", found, len(alike), "components", len(kept), len({top(i) for i in range(len(texts))}))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)] + [(9, 9)]
    linked = {frozenset(e) for e in edges}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    tops = groups_of(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    found = components(spark.createDataFrame(edges, "src long, dst long"))
    same(found.collect(), [(n, nodes[t]) for n, t in zip(nodes, tops)])


def plain_shards(rows, shards):
    """(id, size, shard, slot) of ``id, size, key, tie`` rows: units of equal texts by class, each by the byte at its middle.

    The level that shards can reach together is the least of what any number of the emptiest could reach alone.
    """
    weight = Counter()
    for r in rows:
        weight[r[2]] += r[1]
    limit = sum(weight.values()) / (4 * shards)
    unit = lambda r: weight[r[2]] if weight[r[2]] <= limit else r[1]
    held, count, out = [0] * shards, [0] * shards, []
    for c in sorted({unit(r).bit_length() for r in rows}, reverse=True):
        own = sorted((r for r in rows if unit(r).bit_length() == c), key=lambda r: (r[2], r[3], r[0] is not None, r[0] or 0, r[1]))
        rest, low = sum(r[1] for r in own), sorted(held)
        level = min((rest + sum(low[:n])) / n for n in range(1, shards + 1))
        edges, at, got = np.cumsum([max(0, round(level - h)) for h in held])[:-1], 0, [0] * shards
        for _, same_text in itertools.groupby(own, lambda r: r[2] if weight[r[2]] <= limit else (r[3], r[0])):
            same_text = list(same_text)
            s = sum(2 * e <= 2 * at + unit(same_text[0]) for e in edges)
            for r in same_text:
                at += r[1]
                out.append((r[0], r[1], s, count[s]))
                count[s] += 1
                got[s] += r[1]
        held = [a + b for a, b in zip(held, got)]
    return out


@pytest.mark.parametrize("shards, options", [(5, {}), (3, {"sample": 40, "ranges_per_shard": 2}), (1, {})])
def test_sharding_against_a_scan(spark, docs, rows, shards, options):
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 16).alias("size"), F.xxhash64(text), F.xxhash64("doc_id")).collect()
    found = sharding.shard(docs, shards, **options)
    same(found.select("doc_id", "size", "shard").collect(), [r[:3] for r in plain_shards([tuple(r) for r in keys], shards)])
    found = pd.DataFrame([x.asDict() for x in found.collect()])
    sizes = [len((t or "").encode()) + 16 for _, t, _, _ in rows]
    assert found["size"].sum() == sum(sizes)
    assert sorted(found.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t, _, _ in rows)
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(frame(spark, [])).count() == 0


def test_groups_of_equal_texts_are_kept_whole(spark):
    r = random.Random(21)
    texts = [sentence(r, r.randrange(1, 60)) for _ in range(400)]
    rows = [(i, texts[min(int(r.paretovariate(0.9)), 399)] if i % 2 else sentence(r, 30), "en", "s") for i in range(4000)]
    rows += [(None, None, None, None), (5, "", None, None), (5, "", None, None)]
    table = frame(spark, rows).withColumnsRenamed({"lang": "shard", "source": "class"}).withColumn("slot", F.lit(1)).withColumn("unit", F.lit(2))
    found = pd.DataFrame([x.asDict() for x in sharding.shard(table.repartition(7), 8, sample=500).collect()])
    share = found["size"].sum() / 8
    for _, group in found.groupby(["text_crc32", "size"]):
        assert group.shard.nunique() == 1 or group["size"].sum() > share / 4
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.01 * share
    again = pd.DataFrame([x.asDict() for x in sharding.shard(table.repartition(3), 8, sample=900).collect()])
    columns = ["doc_id", "size", "text_crc32", "shard"]
    assert found[columns].sort_values(columns).reset_index(drop=True).equals(again[columns].sort_values(columns).reset_index(drop=True))


def test_a_hot_text_is_spread_over_shards(spark):
    for ids in (lambda i: i, lambda i: 7):  # of many ids, and of one
        rows = [(ids(i), "same text " * 20 if i % 3 else f"text {i}" * 25, None, None) for i in range(3000)]
        found = sharding.shard(frame(spark, rows), 10, sample=300).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()
        assert len(found) == 10 and found.n.max() - found.n.min() <= 1000


def test_large_rows_do_not_make_shards_uneven(spark):
    r = random.Random(12)
    rows = [(i, "x" * r.choice([10, 100, 20_000 if i % 20 == 0 else 50]), None, None) for i in range(2000)]
    found = pd.DataFrame([x.asDict() for x in sharding.shard(frame(spark, rows), 7).collect()])
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 7 and sizes.max() - sizes.min() < 0.03 * sizes.mean()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_room_fills_to_one_level():
    assert sharding._room([5, 0, 0], 4) == [0, 2, 2]
    assert sharding._room([1, 2, 3], 6) == [3, 2, 1]
    assert sharding._room([0, 0], 0) == [0, 0]


def test_language_id(spark):
    r = random.Random(6)
    vocab = {"en": "the and of with thing", "fr": "le que été mais où", "de": "der und nicht über groß"}
    rows = [(i, sentence(r, r.randrange(3, 80), vocab[lang].split()), lang, "s") for i in range(300) for lang in [r.choice(list(vocab))]]
    rows += [(900, None, "en", None), (901, "123 !", "en", None), (902, "", None, None), (None, "le que", None, None)]
    docs = frame(spark, rows)
    found = language_id.identify(docs, docs.where(~language_id.held_out()))
    got = {x.doc_id: (x.language.lang, x.language.score) for x in found.collect()}
    held = [x for x in rows if x[0] is not None and x[0] < 900 and zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([got[i][0] == lang for i, _, lang, _ in held]) > 0.97
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.known(docs).count() == 301 and language_id.known(docs).columns == docs.columns
    unlearned = language_id.identify(docs, docs.limit(0)).select("language.lang").distinct().collect()
    assert [x.lang for x in unlearned] == ["und"]


@pytest.mark.parametrize("block, lanes", [(512, 4096), (7, 5), (1, 3)])
def test_phrases_against_a_search_in_the_labelled_text(monkeypatch, block, lanes):
    """Whole texts, whatever blocks they are parsed in: long ones, periodic ones, parts of the labelled text, rare letters."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "LANES", lanes)
    r = random.Random(8)
    many = "".join(chr(c) for c in range(0x4E00, 0x4E40))
    labelled = {"a": sentence(r, 200), "b": sentence(r, 150, ["xy", "yz", "zx"]), "c": "".join(r.choice(many) for _ in range(300)) + "\U00020000"}
    model = language_id.build(labelled)
    lines = {n: "".join(map(chr, language_id.symbols_of(t, model.symbols)[0])) for n, t in labelled.items()}
    texts = [sentence(r, 90), "xyz yzx " * 30, "q", "ab cdx", "ÀÉ " * 4, sentence(r, 400), labelled["a"][100:700], "ab " * 300, "", None, labelled["c"][50:90], many[::-1] + "\U00020000\U00020001"]
    found, lettered = language_id.phrases(texts, model)
    assert lettered.tolist() == [bool(t) for t in texts]
    for i, t in enumerate(texts):
        line = "".join(map(chr, language_id.symbols_of(t or "", model.symbols)[0]))
        for k, n in enumerate(model.names):
            count, here = int(bool(line)), ""
            for c in line:
                if here + c in lines[n]:
                    here += c
                else:
                    count += 1
                    here = c if c in lines[n] else ""
            assert found[i, k] == count, (i, n)
    assert found[10].argmin() == 2


def test_language_ties_repeats_and_clashing_names(spark):
    docs = frame(spark, [(1, "ab cd", None, None), (1, "ab cd", None, None), (2, None, None, None)])
    docs = docs.withColumn("language", F.lit("own")).withColumn("_q_language", F.lit(7))
    learned = frame(spark, [(5, "ab cd ef", "bb", None), (6, "ab cd ef", "aa", None)])
    found = language_id.identify(docs, learned)
    assert found.columns == docs.columns
    got = sorted((x.doc_id, x.language.lang, x.language.score, x["_q_language"]) for x in found.collect())
    assert got == [(1, "aa", 0.5, 7), (1, "aa", 0.5, 7), (2, "und", 0.0, 7)]
    assert language_id.known(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(0))).columns == docs.columns


def test_scripts_of_many_letters_stay_apart():
    """Two languages whose letters are all rare ones: the same symbol for all would make them one."""
    r = random.Random(9)
    one, two = ("".join(chr(first + i) for i in range(400)) for first in (0xAC00, 0x4E00))
    write = lambda letters: " ".join("".join(r.choice(letters) for _ in range(3)) for _ in range(800))
    model = language_id.build({"en": sentence(r, 900), "ko": write(one), "zh": write(two)})
    found, _ = language_id.phrases([write(one), write(two), sentence(r, 50)], model)
    assert (found * model.weights).argmin(axis=1).tolist() == [1, 2, 0]


def test_learned_texts_are_whole():
    assert language_id._fitting(["aaaa", "b" * 9, "cc", "d" * 90], 12) == "aaaa\ncc"


def plain_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, met = cut(text), set(), set()
    for name, t in items:
        item = cut(t)
        for i in range(max(1, len(item) - 12)) if item else ():
            w = item[i : i + 13]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    met.add(str(name))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def test_decontamination(spark):
    r = random.Random(7)
    items = [(i, sentence(r, r.choice([3, 8, 13, 20, 40]))) for i in range(30)] + [(50, None), (51, "?!"), (52, "Été O'Neil"), (2, "second two")]
    rows = []
    for i in range(60):
        t = sentence(r, 60)
        if i % 3 == 0:
            item = r.choice(items[:30])[1].split()
            a = r.randrange(max(1, len(item) - 13))
            t += " -- " + " ".join(item[a : a + 15]).upper() + ", " + sentence(r, r.choice([0, 400]))
        rows.append((i, t, None, None))
    rows += [(900, None, None, None), (901, "", None, None), (902, "x été O'NEIL!", None, None), (902, "a été o’neil", None, None)]
    docs = frame(spark, rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = [(i, *plain_hits(t, items)) for i, t, _, _ in rows]
    clash = docs.withColumn("_q_hits", F.lit(1)).withColumn("f", F.lit(2))
    for block in (64 << 20, 500):  # in one automaton, or in several one after another
        found = decontaminate.scan(clash, table, out="f", block_bytes=block)
        assert found.columns == clash.columns
        same(found.select("doc_id", "f.n_words", "f.n_hit", "f.n_items", "f.items_sha256").collect(), wanted)
    for x in found.where("f.n_hit > 0").collect():
        parts = [x.text.encode()[s.start : s.end].decode() for s in x.f.spans]
        assert sum(len(decontaminate.words(p)) for p in parts) == x.f.n_hit
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (n and 20 * n >= w) for _, w, n, _, _ in wanted)
    assert decontaminate.clean(docs, table.limit(0)).count() == len(rows)


def test_embedding_dedup(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    x = [c + r.normal(size=16) * r.choice([0.05, 0.3]) for c in centres for _ in range(25)]
    rows = [(i, [float(np.float32(v)) for v in y], int(i % 3)) for i, y in enumerate(x)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(1010, [2 * v for v in rows[0][1]], 0)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, rows[0][1], None)]
    good = lambda v: v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    def cos(i, j):
        a, b = rows[i], rows[j]
        if a[2] != b[2] or a[2] is None or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return 0
        p, q = np.array(a[1]), np.array(b[1])
        return p @ q / np.sqrt(p @ p) / np.sqrt(q @ q)

    n = len(rows)
    linked = [[i != j and cos(i, j) >= 0.93 for j in range(n)] for i in range(n)]
    tops = groups_of(n, lambda i, j: linked[i][j])
    wanted = [(rows[i][0], sum(linked[i]), rows[tops[i]][0], tops[i] == i) for i in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for options in ({}, {"cell_rows": 20, "block_rows": 8, "sample_rows": 150}):
        same(embedding_dedup.near_duplicates(table, **options).collect(), wanted)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(table.where("label is null")).count() == 2


def test_queries_have_the_agreed_columns(spark):
    from quire.llm.queries import ORACLE_SQL, QUERIES

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stretches_hold_all_windows(spark):
    """Whatever the filter lets through, no window is lost; a full one lets all through, an empty one nothing."""
    cut = decontaminate.words(sentence(random.Random(3), 200))
    assert decontaminate.stretches(cut, [2, 13], np.full(1 << 13, 255, np.uint8)) == [(0, 200)]
    assert decontaminate.stretches(cut, [2, 13], np.zeros(1 << 13, np.uint8)) == []
    assert decontaminate.stretches([], [1], np.full(1 << 13, 255, np.uint8)) == []
    text = lambda a, b: b" ".join(cut[a:b]).decode()
    items = spark.createDataFrame([("x", text(20, 60)), ("y", text(100, 102)), ("z", "never seen " * 20), ("n", None)], "item string, text string")
    lengths, bits = decontaminate._filter(items, 13, 18)
    assert lengths == [2, 13] and len(bits) == 1 << 15
    assert decontaminate.stretches(cut, lengths, bits) == [(20, 60), (100, 102)]
    assert decontaminate.stretches(decontaminate.words(text(30, 42)), lengths, bits) == []
