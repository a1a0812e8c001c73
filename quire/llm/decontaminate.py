"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, save, text_key

WINDOW = 13
LOG_BITS = 29  # a filter has at most two to this many bits
#: A-Z to a-z; bytes that are neither ASCII letters or digits nor part of a longer character become blanks.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile(rb"[^\x20]+")
FOUND = (
    "n_words long, n_hit long, n_items long, items_sha256 string, "
    "spans array<struct<start: long, end: long>>, items array<string>"
)
_RESIDENT: dict[str, ahocorasick.Automaton] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    """The item's word windows, each with a blank before and after every word."""
    found = words(text)
    return {b" " + b" ".join(found[i : i + size]) + b" " for i in range(max(1, len(found) - size + 1))} if found else set()


def _held(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, text`` of the items that have text."""
    held = items.where(F.octet_length(text_col) > 0)
    return held.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))


def _block(held: DataFrame) -> list[tuple[str, str]]:
    return sorted((r["item"], r["text"]) for r in held.select("item", "text").toLocalIterator())


def _window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, from the hashes of the words."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _word_hashes(cut: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in cut), np.uint64, len(cut))


PROBES = 4


def _probe(hashes: np.ndarray, k: int, log_bits: int) -> np.ndarray:
    """The ``k``-th bit of a filter of two to the ``log_bits`` that stands for each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes + np.uint64(k) * step) & np.uint64((1 << log_bits) - 1)).astype(np.int64)


SEGMENT = 16  # two to this many bits of the filter are made by one group


def _filter(held: DataFrame, size: int, log_bits: int) -> tuple[list[int], np.ndarray]:
    """(lengths of the items' windows, filter bits in which each window is set), put together from segments made in tasks."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["text"]:
                cut = words(text)
                n = min(size, len(cut))
                if n:
                    found = _window_hashes(_word_hashes(cut), n)
                    at = np.unique(np.concatenate([_probe(found, k, log_bits) for k in range(PROBES)]))
                    yield pd.DataFrame({"n": n, "segment": at >> SEGMENT, "bit": at & ((1 << SEGMENT) - 1)})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << SEGMENT, np.uint8)
        own[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "held": [np.packbits(own, bitorder="little").tobytes()]})

    told = save(held.mapInPandas(bits, "n int, segment long, bit int").distinct(), "filter-bits")
    lengths = sorted(r["n"] for r in told.select("n").distinct().collect())
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    width = 1 << (SEGMENT - 3)
    for r in told.select("segment", "bit").distinct().groupBy("segment").applyInPandas(packed, "segment long, held binary").toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["held"], np.uint8)
    return lengths, out


def stretches(cut: list[bytes], lengths: list[int], bits: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of the runs of words in which all windows that the filter lets through lie."""
    hashes, log_bits = _word_hashes(cut), int(len(bits) * 8).bit_length() - 1
    edges = np.zeros(len(cut) + 1, np.int64)
    for n in lengths:
        found = _window_hashes(hashes, n)
        at = np.arange(len(found))
        for k in range(PROBES):
            probe = _probe(found[at], k, log_bits)
            at = at[(bits[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1]
        edges[at] += 1
        edges[at + n] -= 1
    turns = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def _automaton(block: list[tuple[str, str]], name: str, size: int) -> ahocorasick.Automaton:
    """The automaton of a block's windows, built once in each worker; one is held at a time."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        by: dict[bytes, set[str]] = defaultdict(set)
        for item, text in block:
            for w in windows(text, size):
                by[w].add(item)
        a = ahocorasick.Automaton()
        for w, names in by.items():
            a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, sorted(names)))
        a.make_automaton()
        _RESIDENT[name] = a
    return _RESIDENT[name]


def _line(text: str | None) -> tuple[str, int]:
    """The text's words with one blank around each, a character per byte, and their number."""
    cut = words(text)
    return (b" " + b" ".join(cut) + b" ").decode("latin-1"), len(cut)


def hits(line: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, list[str]]]:
    """(first word, last word, items) of each window in ``line``, whose words have one blank around each."""
    met = list(automaton.iter(line)) if len(automaton) else []
    if not met:
        return []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(blanks, [end for end, _ in met]) - 1
    return [(int(k) - n + 1, int(k), names) for k, (_, (n, names)) in zip(last, met)]


def judge(text: str | None, found: list[tuple[int, int, list[str]]], n_words: int) -> tuple:
    if not found:
        return n_words, 0, 0, hashlib.sha256(b"").hexdigest(), [], []
    edges = np.zeros(n_words + 1, np.int64)
    for first, last, _ in found:
        edges[first] += 1
        edges[last + 1] -= 1
    hit = np.cumsum(edges[:-1]) > 0
    names = sorted({x for _, _, y in found for x in y})
    at = [m.span() for m in WORD.finditer(text.encode("utf-8", "surrogatepass").translate(FOLD))]
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(turns[::2], turns[1::2])]
    return n_words, int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), spans, names


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_bytes: int = 1 << 20,
    out: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``out``: which words of its text lie in windows of test items.

    Texts and items are lower-cased (A-Z) and cut into words of ASCII letters,
    digits and characters beyond ASCII. An item's windows are its runs of
    ``size`` words, or all its words if they are fewer. One automaton, built in
    the workers, holds all windows and reads each whole text once, inside the
    task that reads the row: no shuffle. ``spans`` are the maximal runs of hit
    words as byte offsets in the original text; ``items`` the ids met.

    Test items of more than ``block_bytes`` of text don't fit one automaton.
    Then, too, the texts are scanned once: a Bloom filter over the hashes of
    all windows (16 bits a window of average words, at most 64 MB, made in
    tasks) picks the stretches of words that may hold one, and those stretches
    are saved. A block of items at a time, by hash, has its automaton, which
    reads the stretches alone and decides; the driver, a broadcast and a worker
    hold one block. A larger test set makes more passes over the stretches,
    never over the texts; a filter fuller than meant lets longer stretches
    through and changes no result. The hits are joined to the rows by a digest
    of the text.

    Null and empty texts have no words; items without words have no windows; a
    null item id is written as an empty string; items with equal ids count
    once; a column named as ``out`` is replaced.
    """
    spark = docs.sparkSession
    held = _held(items, item_id_col, item_text_col)
    n_bytes = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // block_bytes))
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "spans", "items"]

    def sent(block: list[tuple[str, str]]):
        return hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest(), spark.sparkContext.broadcast(block)

    if n_blocks == 1:
        name, block = sent(_block(held))

        @F.pandas_udf(FOUND)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                a = _automaton(block.value, name, size)
                lines = [_line(t) for t in texts]
                yield pd.DataFrame([judge(t, hits(x, a), n) for t, (x, n) in zip(texts, lines)], columns=columns)

        return docs.withColumn(out, found(F.col(text_col)))

    held = save(held.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int")), "items", by="block")
    lengths, bits = _filter(held, size, min(LOG_BITS, max(SEGMENT, int(n_bytes * 16 // 6).bit_length())))
    sent_bits = spark.sparkContext.broadcast(bits)

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, t in zip(pdf["uid"], pdf["text"]):
                cut = words(t)
                rows += [(u, a, b" " + b" ".join(cut[a:b]) + b" ") for a, b in stretches(cut, lengths, sent_bits.value)]
            yield pd.DataFrame(rows, columns=["uid", "first", "line"])

    texts = docs.select(text_key(F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    lines = save(texts.mapInPandas(picked, "uid binary, first int, line binary"), "stretches")
    sent_bits.unpersist()
    passes = []
    for nth in range(n_blocks):
        name, block = sent(_block(held.where(F.col("block") == nth)))

        def met(batches: Iterator[pd.DataFrame], name=name, block=block) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                a = _automaton(block.value, name, size)
                rows = [
                    (u, at + x[0], at + x[1], list(x[2]))
                    for u, at, line in zip(pdf["uid"], pdf["first"], pdf["line"])
                    for x in hits(bytes(line).decode("latin-1"), a)
                ]
                yield pd.DataFrame(rows, columns=["uid", "first", "last", "names"])

        passes.append(save(lines.mapInPandas(met, "uid binary, first int, last int, names array<string>").distinct(), f"hits-{nth}"))
        block.unpersist()
    every = reduce(DataFrame.unionByName, passes).groupBy("uid").agg(F.collect_list(F.struct("first", "last", "names")).alias("hits"))
    uid, held = fresh("_q_uid", docs), fresh("_q_hits", docs)
    every = every.select(F.col("uid").alias(uid), F.col("hits").alias(held))

    @F.pandas_udf(FOUND)
    def judged(texts: pd.Series, hit: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(texts, hit):
            own = [] if own is None else [(int(x["first"]), int(x["last"]), list(x["names"])) for x in own]
            rows.append(judge(t, own, len(words(t))))
        return pd.DataFrame(rows, columns=columns)

    joined = docs.withColumn(uid, text_key(F.col(text_col))).join(every, uid, "left")
    return joined.withColumn(out, judged(F.col(text_col), F.col(held))).select(*dict.fromkeys([*docs.columns, out]))


def contaminated(found: str = "found", share: int = 20) -> F.Column:
    """True where a hit word stands in a text and hit words make up at least one in ``share``."""
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * share >= F.col(f"{found}.n_words"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    own = fresh("_q_found", docs)
    return scan(docs, items, text_col, out=own, **options).where(~contaminated(own)).select(*docs.columns)
