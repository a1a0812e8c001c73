"""Removal of repeated passages with a range-partitioned sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, save, text_key

LENGTH = 400  # bytes of a repeated string
GRAM = 100  # bytes of an anchor
WORD_GRAM = 12  # words of an anchor
STEP = 1 << 19  # window starts that are looked at together
CELL = 16
FLUSH = 50_000  # rows that a task holds before it passes them on
BUCKET = 300_000  # suffixes that one task sorts
LOW = (1 << 21) - 1
BASE = 0x9E3779B97F4A7C15
CORE = ["w0", "w1", "core"]  # two leading tokens of 8 bytes, and a digest of all that the windows of a suffix share
KEYS = [*CORE, "f0", "f1"]  # and 128 bits for all that they cover
SUFFIX = "w0 long, w1 long, core long, f0 long, f1 long, num long, run long, more array<long>"
BY_WORD = 1 << 62  # in a run: it is of words, not of bytes
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f\x0b", np.uint8))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A 64-bit number per byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([c]), digest_size=8).digest(), "big") for c in range(256)], np.uint64)


class Words:
    """A text as a sequence of words, which end at ASCII white space: it is sliced by words, to their 64-bit digests as bytes."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        turns = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[codes], [True]]).astype(np.int8)))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.values = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # blocks of words, so that a very long text needs no tables of its own length
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + STEP, side="right")))
            origin = int(self.starts[at])
            sums, down = _sums(_values()[codes[origin : self.ends[to - 1]]])
            begin, end = self.starts[at:to] - origin, self.ends[at:to] - origin
            self.values[at:to] = _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
            at = to
        self.digests = self.values.tobytes()

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, at: slice) -> bytes:
        return self.digests[8 * at.start : 8 * at.stop]

    def spans(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of words as spans of bytes, without the white space around them."""
        return [(int(self.starts[a]), int(self.ends[b - 1])) for a, b in found]


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial in ``BASE``, and what shifts a difference of two of them to place 0."""
    up, down = _powers(1 << (len(values) - 1).bit_length() if len(values) > 1 else 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, or of words given by their digests."""
    sums, down = _sums(data if data.dtype == np.uint64 else _values()[data])
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def anchor_blocks(data: bytes | Words, length: int = LENGTH, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Rows ``first, last, anchor, hash``: runs of window starts whose window has its least gram hash at one place.

    Windows of equal bytes have their anchor at an equal offset, wherever they
    stand, so they can only be found among runs whose anchors have equal
    hashes. A very long text comes in blocks; a run between two is not cut.
    """
    whole = data.values if isinstance(data, Words) else np.frombuffer(data, np.uint8)
    span = length - gram + 1
    held = np.empty((0, 4), np.int64)
    for at in range(0, len(data) - length + 1, STEP):
        h = _grams(whole[at : at + STEP + length - 1], gram)
        x = (h & ~np.uint64(LOW)) | np.arange(len(h), dtype=np.uint64)
        n = len(x) - span + 1
        y = np.concatenate([x, np.full(-len(x) % span, ~np.uint64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(y, axis=1).ravel()
        behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(LOW)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        p = place[first]
        block = np.stack([first + at, last + at, p + at, h[p].view(np.int64)], axis=1)
        if len(held) and held[-1, 2] == block[0, 2]:
            block[0, 0] = held[-1, 0]
            held = held[:-1]
        if len(held):
            yield held
        held = block
    if len(held):
        yield held


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    return np.concatenate([np.empty((0, 4), np.int64), *anchor_blocks(data, length, gram)])


def _pack(first, last, anchor):
    """Window starts ``first`` to ``last`` of one anchor in a long; both distances are below 1,024."""
    return (first << 20) | ((last - first) << 10) | (anchor - first)


def _unpack(run: int) -> tuple[int, int, int]:
    run &= BY_WORD - 1
    first = run >> 20
    return first, first + ((run >> 10) & 1023), first + (run & 1023)


def _key(core: bytes, full: bytes, core_hash: int | None = None) -> bytes:
    """Sort key of a suffix: its leading tokens, a digest of its core, and one of all that its windows cover."""
    own = xxhash.xxh3_64_intdigest(core) if core_hash is None else core_hash & (1 << 64) - 1
    return core[:16].ljust(16, b"\0") + own.to_bytes(8, "big") + xxhash.xxh3_128_digest(full)


def cells(data: bytes | Words, run: int, length: int = LENGTH) -> Iterator[tuple[bytes, int]]:
    """``key, run`` of each group of up to 16 windows of a run, aligned by their distance from the anchor.

    All windows at these distances contain the core, in this run or in any
    other; the full string is all that this run's windows cover.
    """
    first, last, anchor = _unpack(run)
    for c in range((anchor - last) // CELL, (anchor - first) // CELL + 1):
        far, near = min(anchor - first, c * CELL + CELL - 1), max(anchor - last, c * CELL)
        core = data[anchor - c * CELL : anchor - c * CELL - CELL + 1 + length]
        full = data[anchor - far : anchor - near + length]
        yield _key(core, b"%d:%d:" % (far, near) + full), _pack(anchor - far, anchor - near, anchor) | run & BY_WORD


def multikey_quicksort(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """An order of the rows of ``words``: three-way partitions by one word, and by the next one where that is equal."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, k:].T[::-1])]
            continue
        w = words[part, k]
        pivot = np.sort(w[[0, (hi - lo) // 2, hi - lo - 1]])[1]
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


def _sorted_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorts one bucket and compares neighbours.

    Kept are ``twin`` rows (equal to a neighbour in all their windows cover),
    ``open`` ones (one of each kind whose core a neighbour of another kind has)
    and the bucket's first and last row (``edge``) for the buckets beside it.
    """
    held = [b for b in batches if len(b)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    k = pdf[KEYS].to_numpy(np.int64)
    order = multikey_quicksort(k)
    k = k[order]
    new_core = np.ones(len(k), bool)
    new_core[1:] = (k[1:, : len(CORE)] != k[:-1, : len(CORE)]).any(axis=1)
    new_kind = new_core.copy()
    new_kind[1:] |= (k[1:, len(CORE) :] != k[:-1, len(CORE) :]).any(axis=1)
    kind, group = np.cumsum(new_kind) - 1, np.cumsum(new_core) - 1
    n = np.bincount(kind)
    n[kind[pdf["more"].notna().to_numpy()[order]]] += 1
    mixed = (np.bincount(group[new_kind]) > 1)[group]
    twin, edge = n[kind] > 1, np.zeros(len(k), bool)
    edge[[0, -1]] = True
    keep = twin | edge | (mixed & new_kind)
    k[~edge] = 0
    out = pdf.iloc[order[keep]].assign(twin=twin[keep], mixed=mixed[keep], open=(mixed & new_kind)[keep], edge=edge[keep])
    out[KEYS] = k[keep]
    out["more"] = pd.Series([x if isinstance(x, np.ndarray) else None for x in out["more"]], index=out.index, dtype=object)
    yield out.assign(bucket=TaskContext.get().partitionId())


def _settled(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(``num, run, more`` that repeat as they are, ``num, run`` of one of each kind that shares its core with another kind).

    Splitters that Spark samples range-partition the suffixes by their leading
    tokens; their last sort columns tell equal suffixes apart, so one that very
    many texts share spreads over buckets. Each bucket is sorted by itself, and
    the first and last suffixes of the buckets are compared across boundaries.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))
    ranged = rows.repartitionByRange(n, *KEYS, "num", "run")
    schema = f"{SUFFIX}, twin boolean, mixed boolean, open boolean, edge boolean, bucket int"
    marked = save(ranged.mapInPandas(_sorted_bucket, schema), f"{name}-sorted")
    edges = marked.where("edge")  # two rows of each bucket at most
    kinds = edges.groupBy(*KEYS).agg(F.count_distinct("bucket").alias("n")).where("n > 1").select(*KEYS)
    cores = edges.groupBy(*CORE).agg(F.max("mixed").alias("any"), F.count_distinct("f0", "f1").alias("n"))
    twins = edges.where("not twin").join(kinds, KEYS, "left_semi")
    across = edges.where("not mixed").join(cores.where("any or n > 1"), CORE, "left_semi")
    solved = marked.where("twin").select("num", "run", "more").union(twins.select("num", "run", "more"))
    return solved, marked.where("open").select("num", "run").union(across.select("num", "run"))


def _per_text(texts: DataFrame, runs: DataFrame, how: str = "inner") -> DataFrame:
    """``texts`` with the list of their runs: as many as a text has bytes at most."""
    return texts.join(runs.groupBy("num").agg(F.collect_list("run").alias("runs")), "num", how)


def _suffix_rows(emit: Callable):
    """A task function that makes the ``SUFFIX`` rows of each text from the keys and runs that ``emit`` yields.

    Runs of one key in one text are one row: periodic text has very many of one kind.
    """

    def table(keys: list[bytes], nums: list[int], runs: list[int], more: dict[int, list[int]]) -> pd.DataFrame:
        k = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, len(KEYS)) ^ np.uint64(1 << 63)
        out = pd.DataFrame(k.view(np.int64), columns=KEYS)
        out["num"], out["run"] = np.array(nums, np.int64), np.array(runs, np.int64)
        out["more"] = pd.Series([more.get(i) for i in range(len(out))] if more else [None] * len(out), index=out.index, dtype=object)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, nums, runs, more = [], [], [], {}
            for r in pdf.itertuples(index=False):
                at: dict[bytes, int] = {}
                for key, own in emit(Reader(r.text), r.runs):
                    i = at.setdefault(key, len(keys))
                    if i < len(keys):
                        more.setdefault(i, []).append(own)
                        continue
                    keys.append(key)
                    nums.append(r.num)
                    runs.append(own)
                    if len(keys) >= FLUSH:
                        yield table(keys, nums, runs, more)
                        keys, nums, runs, more, at = [], [], [], {}, {}
            yield table(keys, nums, runs, more)

    return run


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Reader:
    """A text as bytes, and as words once they are asked for."""

    def __init__(self, text: str | None):
        self.bytes = _bytes(text)
        self._words: Words | None = None

    def of(self, run: int) -> bytes | Words:
        if not run & BY_WORD:
            return self.bytes
        self._words = self._words or Words(self.bytes)
        return self._words


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``num, uid, text, copies``: a row per distinct text. It is written, so that its numbers stay."""
    texts = (
        docs.select(text_key(F.col(text_col)).alias("uid"), F.coalesce(text_col, F.lit("")).alias("text"))
        .groupBy("uid")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    return save(texts.withColumn("num", F.monotonically_increasing_id()), "texts")


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """Per distinct text of ``docs``: ``uid, n_bytes, removed, n_removed, kept_sha256, repeated, n_repeated_words``.

    A byte is repeated if a string of ``length`` bytes that covers it also
    starts anywhere else, in the same text, a copy or another one; ``removed``
    are the spans of such bytes. With ``words`` given, ``repeated`` are the
    spans (of bytes, too) of the words that lie in strings of so many words
    which start anywhere else, whatever white space parts them. Steps:

    1. Copies become one text with a count (a grouping with a map-side
       combine); a text with copies is repeated as a whole.
    2. A filter: in each window of ``length`` bytes the least hash of ``gram``
       bytes is its anchor. Equal windows have their anchors at equal places,
       so windows whose anchor occurs once in the corpus cannot repeat. All
       windows of one anchor are a run.
    3. A suffix array of the runs whose anchors occur twice, one suffix a run,
       from its anchor on. Sampled splitters range-partition it by two leading
       tokens of 8 bytes, each bucket is sorted by multikey quicksort, and
       neighbours are compared, across the boundaries of buckets as well. Runs
       equal to a neighbour are repeated; those that only share the anchor
       with one are open.
    4. The same for the suffixes of open runs, one for 16 windows, aligned by
       their anchors; and then for the suffixes of open cells, one a window.
    5. Each text gets its intervals back.

    Words go the same way as bytes and in the same steps, each as a digest of
    64 bits. The order is that of the first two tokens; beyond them it is that
    of digests, as only equality counts there. What decides that two suffixes
    are equal are those 16 bytes and 192 bits of digests. Nothing is collected
    on the driver, and no group has more in one task than a bucket or one
    text. Null texts count as empty; texts of fewer than ``length`` bytes have
    no repeats; further columns are ignored.
    """
    texts = _texts(docs, text_col)
    units = {0: (length, gram)} | ({BY_WORD: (words, max(1, min(WORD_GRAM, words // 4)))} if words else {})
    least = min(length, 2 * words - 1) if words else length
    long = texts.where(F.octet_length("text") >= least).select("num", "text")

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cores, nums, runs, n = [], [], [], 0
            for num, text in zip(pdf["num"].tolist(), pdf["text"]):
                reader = Reader(text)
                for unit, (size, own) in units.items():
                    for a in anchor_blocks(reader.of(unit), size, own):
                        cores.append(a[:, 3] ^ (unit >> 1))
                        runs.append(_pack(a[:, 0], a[:, 1], a[:, 2]) | unit)
                        nums.append(np.full(len(a), num, np.int64))
                        n += len(a)
                        if n > FLUSH:
                            yield pd.DataFrame({"core": np.concatenate(cores), "num": np.concatenate(nums), "run": np.concatenate(runs)})
                            cores, nums, runs, n = [], [], [], 0
            if n:
                yield pd.DataFrame({"core": np.concatenate(cores), "num": np.concatenate(nums), "run": np.concatenate(runs)})

    def whole(reader: Reader, runs) -> Iterator[tuple[bytes, int]]:
        for x in runs.tolist():
            data, (size, own) = reader.of(x), units[x & BY_WORD]
            s, e, at = _unpack(x)
            yield _key(data[at : at + own], b"%d:%d:" % (at - s, at - e) + data[s : e + size]), x

    def split(reader: Reader, runs) -> Iterator[tuple[bytes, int]]:
        for x in runs.tolist():
            yield from cells(reader.of(x), x, units[x & BY_WORD][0])

    def single(reader: Reader, runs) -> Iterator[tuple[bytes, int]]:
        for x in runs.tolist():
            data, size = reader.of(x), units[x & BY_WORD][0]
            first, last, _ = _unpack(x)
            for p in range(first, last + 1):
                s = data[p : p + size]
                yield _key(s, s), p << 20 | x & BY_WORD

    anchors_of = save(long.mapInPandas(anchored, "core long, num long, run long"), "anchors")
    twice = anchors_of.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    left = anchors_of.join(twice, "core", "left_semi").select("num", "run")
    solved = None
    for emit, name in ((whole, "runs"), (split, "cells"), (single, "windows")):
        left = save(left, f"open-{name}")
        rows = save(_per_text(long, left).mapInPandas(_suffix_rows(emit), SUFFIX), name)
        more, left = _settled(rows, name)
        solved = more if solved is None else solved.union(more)
    solved = solved.select("num", F.explode(F.concat(F.array("run"), F.coalesce("more", F.array().cast("array<long>")))).alias("run"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                reader = Reader(r.text)
                runs = np.asarray(r.runs if r.runs is not None else [], np.int64)
                by_word = runs & BY_WORD != 0
                data = reader.bytes
                spans = covered(runs[~by_word], len(data), length) if r.copies < 2 or len(data) < length else [(0, len(data))]
                kept = hashlib.sha256(data if not spans else keep(data, spans)).hexdigest()
                said = []
                if words and (by_word.any() or r.copies > 1):
                    seq = reader.of(BY_WORD)
                    said = covered(runs[by_word] & BY_WORD - 1, len(seq), words) if r.copies < 2 or len(seq) < words else [(0, len(seq))]
                n_words, said = sum(b - a for a, b in said), seq.spans(said) if said else []
                listed = [[{"start": a, "end": b} for a, b in x] for x in (spans, said)]
                out.append((r.uid, len(data), listed[0], sum(b - a for a, b in spans), kept, listed[1], n_words))
            yield pd.DataFrame(out, columns=["uid", "n_bytes", "removed", "n_removed", "kept_sha256", "repeated", "n_repeated_words"])

    span = "array<struct<start: long, end: long>>"
    schema = f"uid binary, n_bytes long, removed {span}, n_removed long, kept_sha256 string, repeated {span}, n_repeated_words long"
    return save(_per_text(texts, solved, "left").mapInPandas(cut, schema), "repeats")


def covered(runs, n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal spans of bytes that the windows of ``runs`` cover."""
    if runs is None or not len(runs):
        return []
    x = np.sort(np.asarray(runs, np.int64))
    first = x >> 20
    end = np.maximum.accumulate(np.minimum(first + ((x >> 10) & 1023) + length, n))
    new = np.flatnonzero(first[1:] > end[:-1]) + 1
    return list(zip(first[np.concatenate([[0], new])].tolist(), end[np.concatenate([new - 1, [-1]])].tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same bytes in maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    words: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, removed``, see ``repeats``.

    With ``words`` given, also ``repeated`` and ``n_repeated_words``: the spans
    (in bytes) and the number of words that lie in strings of so many words
    which start anywhere else, too, however few bytes they have. Rows that
    repeat a document each get a row. An empty table gives no rows.
    """
    found = repeats(docs, text_col, length, gram, words)
    rows = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("uid"))
    return rows.join(found, "uid").select(
        id_col,
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
        "removed",
        *(["repeated", "n_repeated_words"] if words else []),
    )


def cut(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text_col``, and all rows and columns kept.

    With ``words`` given, strings of so many words that start twice are cut as
    well, however few bytes they have and whatever white space parts them; the
    white space around them stays. Both kinds are sought in the whole texts.
    What is left of a character that a cut went through is left out; a null
    text stays null. ``n_chars``, where the table has it, is counted anew.
    """
    found = repeats(docs, text_col, length, gram, words)
    found = found.select("uid", F.concat("removed", "repeated").alias("removed")).where(F.size("removed") > 0)
    uid, removed = fresh("_q_uid", docs), fresh("_q_removed", docs)
    found = found.select(F.col("uid").alias(uid), F.col("removed").alias(removed))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, starts, ends):
            spans = [] if a is None else merged(list(zip(a.tolist(), b.tolist())))
            out.append(keep(_bytes(t), spans).decode("utf-8", "ignore") if spans else t)
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(uid, text_key(F.col(text_col))).join(found, uid, "left")
    text = kept(F.col(text_col), F.transform(removed, lambda s: s["start"]), F.transform(removed, lambda s: s["end"]))
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
