"""Ranked lexical search with hashed max-sketches.

A document's sketch holds, for each of ``COORDINATES`` hash values of terms, the
greatest frequency among its terms of that value. A term's impact on a score
grows with its frequency and hangs on nothing else but the document's length,
so the greatest frequency stands for the greatest impact. Queries are looked up
in batches: the sum of their weights times the impacts of their coordinates is
an upper bound of a document's score. Documents are scored exactly in descending
order of that bound, until no bound reaches the score of the last place.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

#: Letters and digits of ASCII and all that lies beyond it make terms; only A-Z are put in lower case.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
COORDINATES = 1 << 16
FIRST = 64  # documents of a query that are scored exactly at first; each further round takes RISE times as many
RISE = 8
BLOCK_POSTINGS = 500_000  # coordinates of the sketches of a block
BLOCK_DOCS = 8192
BLOCK_QUERIES = 256
MAX_BROADCAST = 500_000  # ids and digests of documents that are scored exactly, some 25 MB; beyond it they are joined
SLICE = 1 << 20  # bytes that are cut into terms at a time
HELD = 500_000  # terms that a task counts before it hands them on
NO_ID = -(1 << 63)

SKETCHED = "kind string, id long, digest binary, length long, at binary, most binary, term binary, n long"
CHOSEN = "item long, row long, id long, digest binary, length long, bound long"


def terms(text: bytes) -> Counter:
    """Frequencies of the terms of a text."""
    plain, found, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def _sketched(coordinates: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sketches of documents and, beside them, in how many documents each term is."""
    columns = [c.split()[0] for c in SKETCHED.split(", ")]

    def sketch(found: Counter, known: dict[bytes, int]) -> tuple[int, bytes, bytes]:
        if len(known) > HELD:
            known.clear()
        at = np.array([known[t] if t in known else known.setdefault(t, zlib.crc32(t) % coordinates) for t in found], np.int64)
        often = np.fromiter(found.values(), np.int64, len(found))
        order = np.lexsort((-often, at))
        at, most = at[order], often[order]
        first = np.concatenate([[True], at[1:] != at[:-1]])
        return int(often.sum()), at[first].astype(np.uint16).tobytes(), most[first].astype(np.uint32).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        counted: Counter = Counter()

        def counts() -> pd.DataFrame:
            out = pd.DataFrame({"term": list(counted), "n": list(counted.values())}).assign(kind="term")
            counted.clear()
            return out.reindex(columns=columns)

        for batch in batches:
            rows = []
            for id_, text in zip(batch["id"], batch["text"]):
                found = terms(bytes(text)) if text is not None else Counter()
                if found:
                    counted.update(found.keys())
                    rows.append((id_, hashlib.sha256(text).digest(), *sketch(found, known)))
            made = pd.DataFrame(rows, columns=["id", "digest", "length", "at", "most"]).assign(kind="sketch")
            yield made.reindex(columns=columns)
            if len(counted) > HELD:
                yield counts()
        yield counts()

    return run


def impact(often, mass):
    """What each unit of weight adds for a term that a document of ``mass`` has ``often``."""
    return (1_000_000_000 * often) // (1000 * often + 8 * mass)


def mass(length, docs: int, total: int):
    return 10 + (90 * length * docs) // total


def _bounds(docs: int, total: int, coordinates: int, take: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The ``take`` documents of a block with the highest bounds for each query of a block, after its cursor and from its floor on."""

    def run(sketches: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in CHOSEN.split(", ")})]
        if len(sketches) and len(queries):
            sketches = sketches.sort_values(["id", "row"])  # equal bounds go by id
            ids, rows = sketches["id"].to_numpy(), sketches["row"].to_numpy()
            at = [np.frombuffer(x, np.uint16) for x in sketches["at"]]
            own = np.repeat(np.arange(len(at)), [len(x) for x in at])
            often = np.concatenate([np.frombuffer(x, np.uint32) for x in sketches["most"]]).astype(np.int64)
            at = np.concatenate(at)
            asked = np.zeros(coordinates, bool)
            asked[queries["at"]] = True
            met = asked[at]
            own, at = own[met], at[met]
            worth = impact(often[met], mass(sketches["length"].to_numpy(np.int64), docs, total)[own])
            order = np.argsort(at, kind="stable")
            own, at, worth = own[order], at[order], worth[order]
            queries = queries.sort_values("at")
            named, item = np.unique(queries["item"], return_inverse=True)
            q_at, weight = queries["at"].to_numpy(), queries["weight"].to_numpy(np.int64)
            bounds = np.zeros((len(ids), len(named)), np.int64)
            for c in np.unique(at):
                a, b = np.searchsorted(at, [c, c + 1])
                x, y = np.searchsorted(q_at, [c, c + 1])  # one row an item
                bounds[np.ix_(own[a:b], item[x:y])] += np.outer(worth[a:b], weight[x:y])
            cursors = queries.groupby("item")[["last_bound", "last_id", "last_row", "floor"]].first()
            for k, (last_bound, last_id, last_row, floor) in enumerate(cursors.to_numpy()):
                b = bounds[:, k]
                later = (ids > last_id) | ((ids == last_id) & (rows > last_row))
                may = np.flatnonzero((b >= floor) & ((b < last_bound) | ((b == last_bound) & later)))
                best = may[np.argsort(-b[may], kind="stable")[:take]]
                found = sketches.iloc[best][["row", "id", "digest", "length"]]
                out.append(found.assign(item=named[k], bound=b[best]))
        return pd.concat(out)[[c.split()[0] for c in CHOSEN.split(", ")]]

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The terms of documents with their frequencies."""
    for batch in batches:
        for id_, digest, text in zip(batch["id"], batch["digest"], batch["text"]):
            found = terms(bytes(text))
            yield pd.DataFrame({"id": id_, "digest": [digest] * len(found), "term": list(found), "often": list(found.values())})


def _terms_of(texts: pd.Series) -> pd.Series:
    return pd.Series([list(terms(bytes(t))) if t is not None else [] for t in texts], dtype=object)


def _named(items: DataFrame, counts: DataFrame, docs: int, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(number and id of each item, its terms with their weights)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{item}`").cast("string")), F.lit("-"))
    rows = items.select(key.alias("key"), F.col(f"`{item}`").alias("named"), F.col(f"`{text}`").cast("binary").alias("text"))
    names = rows.groupBy("key").agg(F.first("named").alias("named"))
    names = save(names.withColumn("item", F.monotonically_increasing_id()), "items")
    own = rows.select("key", F.explode(F.pandas_udf(_terms_of, "array<binary>")("text")).alias("term")).distinct().join(names, "key")
    weight = F.floor(1000.0 * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("n") + 1).cast("double")))
    weighed = own.join(counts.groupBy("term").agg(F.sum("n").alias("n")), "term")
    return names, save(weighed.select("item", "term", weight.cast("long").alias("weight")), "asked")


def _chosen(sketches: DataFrame, queries: DataFrame, sizes: tuple[int, int, int], blocks: tuple[int, int], take: int) -> DataFrame:
    """``CHOSEN``: for each query the ``take`` documents with the highest bounds after its cursor, of all blocks."""
    many, asked = blocks
    left = sketches.withColumns(
        {"b": F.pmod(F.xxhash64("row"), F.lit(many)), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))}
    )
    right = queries.withColumns(
        {"q": F.pmod(F.xxhash64("item"), F.lit(asked)), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))}
    )
    run = _bounds(*sizes, take)
    met = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(lambda a, b: run(a, b), CHOSEN)
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "id", "row")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= take).drop("place")


def _exact(chosen: DataFrame, docs: DataFrame, asked: DataFrame, n: int, total: int) -> DataFrame:
    """``item, row, id, bound, score`` of chosen documents, whose texts are read again."""
    wanted = save(chosen.select("id", "digest").distinct(), "wanted")
    few = wanted.count() <= MAX_BROADCAST
    texts = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["id", "digest"], "left_semi")
    found = texts.mapInPandas(_frequencies, "id long, digest binary, term binary, often long")
    found = found.join(asked.select("term").distinct(), "term", "left_semi").dropDuplicates(["id", "digest", "term"])
    m = F.lit(10).cast("long") + F.expr(f"(90L * length * {n}L) div {total}L")
    pairs = chosen.join(asked, "item").withColumn("m", m).join(found, ["id", "digest", "term"])
    worth = F.col("weight") * F.expr("(1000000000L * often) div (1000L * often + 8L * m)")
    sums = pairs.groupBy("item", "row").agg(F.sum(worth).alias("score"))
    return chosen.select("item", "row", "id", "bound").join(sums, ["item", "row"])


def _placed(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ``rank``: highest scores, then lowest ids."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id", "row")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", first: int = FIRST, coordinates: int = COORDINATES,
) -> DataFrame:
    """``item, rank, id, score``: for each of ``items`` its ``k`` highest-scoring documents, equal scores by ascending id.

    Terms are runs of letters and digits, A-Z in lower case. N documents have
    terms, L in all; a term that df of them have weighs floor(1000 * ln((2N + 2)
    / (2df + 1))); a document of n terms has the mass m = 10 + 90nN div L; each
    different term of an item that it has tf times adds weight * (10**9 tf div
    (1000 tf + 8m)). Documents that score 0 are in no answer.

    ``id`` is an integer; a null one comes before all others. Each row of
    ``docs`` is a document, repeated rows too; a null text has no terms. An
    item without terms, or without a term that a document has, has no answer;
    rows of one item id are one item. Empty tables give no rows. Other columns
    are not looked at, whatever their names. At most 65,536 ``coordinates``.
    """
    take = max(first, k)
    rows = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    made = rows.mapInPandas(_sketched(coordinates), SKETCHED).withColumn("row", F.monotonically_increasing_id())
    made = save(made, "sketches", by="kind")
    sketches = made.where("kind = 'sketch'").select("row", "id", "digest", "length", "at", "most")
    n, total, postings = sketches.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.length("at")) / 2).first()
    names, asked = _named(items, made.where("kind = 'term'"), n, item, item_text)
    n_items = names.count()
    sizes = n, total or 1, coordinates
    blocks = math.ceil(max((postings or 1) / BLOCK_POSTINGS, n / BLOCK_DOCS, 1)), max(1, math.ceil(n_items / BLOCK_QUERIES))
    sums = asked.groupBy("item", (F.crc32("term") % coordinates).alias("at")).agg(F.sum("weight").alias("weight"))
    cursors = {"last_bound": (1 << 63) - 1, "last_id": NO_ID, "last_row": -1, "floor": 1}
    queries = sums.withColumns({c: F.lit(v) for c, v in cursors.items()})
    scored = None
    while True:
        chosen = save(_chosen(sketches, queries, sizes, blocks, take), "chosen")
        exact = _exact(chosen, rows, asked, *sizes[:2])
        scored = save(exact if scored is None else scored.unionByName(exact), "scored")
        # an item goes on where its round was full and the documents after it may still come before its last place
        at = F.struct((-F.col("bound")).alias("bound"), "id", "row")
        ended = chosen.groupBy("item").agg(F.count(F.lit(1)).alias("got"), F.max(at).alias("end"))
        last = _placed(scored, k).where(F.col("rank") == k).select("item", F.struct((-F.col("score")).alias("bound"), "id", "row").alias("place"))
        more = ended.where(F.col("got") == take).join(last, "item", "left")
        more = save(more.where(F.col("place").isNull() | (F.col("end") < F.col("place"))), "more")
        if more.isEmpty():
            break
        after = more.select(
            "item", (-F.col("end.bound")).alias("last_bound"), F.col("end.id").alias("last_id"), F.col("end.row").alias("last_row"),
            F.coalesce(-F.col("place.bound"), F.lit(1)).alias("floor"),
        )
        queries, take = sums.join(after, "item"), take * RISE
    found = _placed(scored, k).join(names, "item")
    no_id = F.when(F.col("id") != NO_ID, F.col("id"))
    return found.select(F.col("named").alias(item), "rank", no_id.alias(id), "score")
