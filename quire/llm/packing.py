"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import save

RESULT = "seq_shard int, seq long, slot int, doc_id {}, part int, start long, n_units long, source string, residual long"
KEYED = RESULT + ", row_hash long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _cut(text: str, starts: list[int], capacity: int) -> Iterator[str]:
    """The parts of a text of ``capacity`` words that begin with the words of the given numbers, which rise."""
    wanted, begin, end = iter(starts), None, 0
    start = next(wanted, None)
    for i, word in enumerate(WORD.finditer(text)):
        if begin is not None and i == start + capacity:
            yield text[begin:end]
            begin, start = None, next(wanted, None)
        if i == start:
            begin = word.start()
        end = word.end()
    if begin is not None:
        yield text[begin:end]


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int = 1) -> list[int]:
    """Bin of each ``(size, source bit, cluster bit)`` piece in turn: the fullest bin that fits and does not conflict.

    Open bins stand in the order of their room and age. From the first one
    with enough room the search goes on to the next until the piece's cluster
    is not in the bin's cluster bitmap and its source is in fewer than
    ``per_source`` of its source bitmaps; a new bin is opened if none is left.
    A negative bit conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (room, bin)
    sources: list[list[int]] = []
    clusters: list[int] = []
    chosen = []
    for size, source, cluster in pieces:
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not clusters[b] & c and not (s and all(m & s for m in sources[b])):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
        for i, m in enumerate(sources[b]):
            if not m & s:
                sources[b][i] |= s
                break
        clusters[b] |= c
        if room > size:
            insort(order, (room - size, b))
        chosen.append(b)
    return chosen


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    per_source: int = 4,
    units_per_shard: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster: F.Column | None = None,
) -> DataFrame:
    """Sequences of at most ``capacity`` words: a row per piece with its sequence, place, start and size.

    Words end at ASCII white space. A document of more than ``capacity`` words is cut into pieces of that size
    and a rest; the pieces of one document never share a sequence, nor do two
    documents of one duplicate cluster (``cluster``; else texts that are equal
    but for case and white space). At most ``per_source`` pieces of one source
    share a sequence. Documents are dealt by a hash of id and text to shards
    of about ``units_per_shard`` words, as many as the total asks for, so that
    a hot source or cluster spreads evenly; each shard is packed on its own,
    from the largest piece to the smallest. Only lengths and hashes are moved,
    never texts. Null, blank and empty texts have no words and no row; a null
    source conflicts with nothing; rows that repeat a document are placed
    apart. Ids may be of any type, and null ids are kept as null. An empty table gives no rows; further
    columns are ignored.
    """
    return _pack(docs, capacity, per_source, units_per_shard, id_col, text_col, source_col, cluster).drop("row_hash")


def _row_hash(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _pack(
    docs: DataFrame,
    capacity: int,
    per_source: int,
    units_per_shard: int,
    id_col: str,
    text_col: str,
    source_col: str | None,
    cluster: F.Column | None,
) -> DataFrame:
    """The rows of ``pack`` with ``row_hash``, the hash of id and text of the row that a piece is of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = F.translate(F.lower(text), "\t\n\r\f\x0b", " " * 5)
    folded = F.trim(F.regexp_replace(blank, " {2,}", " "))
    # folded is a column of its own, so that it is made once a row; the empty ones go after the write for the same reason
    held = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        (cluster if cluster is not None else F.lit(None).cast("long")).alias("given"),
        folded.alias("folded"),
        _row_hash(id_col, text_col).alias("h"),
    )
    rows = held.select(
        "doc_id",
        "source",
        F.coalesce("given", F.xxhash64("folded")).alias("cluster"),
        F.when(F.col("folded") == "", 0)
        .otherwise(F.length("folded") - F.length(F.translate("folded", " ", "")) + 1)
        .cast("long")
        .alias("units"),
        "h",
    )
    rows = save(rows, "lengths").where("units > 0")
    total = rows.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    shards = max(1, -(-total // units_per_shard))

    kind = docs.schema[id_col].dataType
    whole_ids = isinstance(kind, T.IntegralType)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        names = {s: i for i, s in enumerate(sorted({s for s in pdf["source"] if s is not None}))}
        bits = {c: i for i, c in enumerate(sorted(set(pdf["cluster"])))}
        for r in pdf.itertuples(index=False):
            doc = None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id) if whole_ids else r.doc_id
            for part, start in enumerate(range(0, int(r.units), capacity)):
                size = min(capacity, int(r.units) - start)
                pieces.append((size, r.cluster, doc, part, start, r.source, r.h))
        pieces.sort(key=lambda p: (-p[0], p[6], str(p[2]), p[3]))
        chosen = best_fit([(p[0], names.get(p[5], -1), bits[p[1]]) for p in pieces], capacity, per_source)
        held: dict[int, int] = {}
        count: dict[int, int] = {}
        for p, b in zip(pieces, chosen):
            held[b] = held.get(b, 0) + p[0]
        out = []
        for p, b in zip(pieces, chosen):
            slot = count[b] = count.get(b, -1) + 1
            out.append((int(pdf["shard"].iloc[0]), b, slot, p[2], p[3], p[4], p[0], p[5], capacity - held[b], p[6]))
        out = pd.DataFrame(out, columns=[x.split()[0] for x in KEYED.split(", ")])
        return out.astype({"doc_id": "Int64"}) if whole_ids else out

    dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(packed, KEYED.format(kind.simpleString()))


def pack_texts(
    docs: DataFrame,
    capacity: int = 2048,
    per_source: int = 4,
    units_per_shard: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster: F.Column | None = None,
) -> DataFrame:
    """``pack`` with the ``text`` of each piece, from its first word to its last, as it stands in the document.

    ``docs`` is read twice and must give the same rows both times. Each text
    moves once, to the list of its document's pieces; rows of one id and text
    have pieces with the same texts, so one of the rows is enough.
    """
    pieces = save(_pack(docs, capacity, per_source, units_per_shard, id_col, text_col, source_col, cluster), "pieces")
    key = lambda h, i: F.concat(h.cast("string"), F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))
    fields = [c for c in pieces.columns if c != "row_hash"]
    lists = pieces.groupBy(key(F.col("row_hash"), F.col("doc_id")).alias("key")).agg(F.collect_list(F.struct(*fields)).alias("pieces"))
    # one key for the rows that repeat and for the join, so that texts are moved once
    texts = docs.select(key(_row_hash(id_col, text_col), F.col(id_col)).alias("key"), F.col(text_col).alias("text"))

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, at in zip(text, starts):
            rising = sorted({int(s) for s in at})
            parts = dict(zip(rising, _cut(t, rising, capacity)))
            out.append([parts[int(s)] for s in at])
        return pd.Series(out, dtype=object)

    held = texts.dropDuplicates(["key"]).join(lists, "key")
    held = held.select("pieces", cut("text", F.col("pieces.start")).alias("texts"))
    held = held.select(F.explode(F.arrays_zip("pieces", "texts")).alias("x"))
    return held.select(*[F.col(f"x.pieces.{c}").alias(c) for c in fields], F.col("x.texts").alias("text"))
