"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import components, fresh, save, text_key

BITS = 64
SHINGLE = 3
RADIUS = 3
BLOCK = 1 << 16  # shingles whose bits are counted at once
SLICE = 1 << 20  # bytes of a text that are cut into words at once
SPACE = re.compile(rb"[\x20\x09-\x0d]")
BANDS = 20
ROWS = 5  # least hashes of a band; texts of similarity 0.8 share none of 20 such bands once in 2,900 times
BINS = 256  # bytes of a sketch
SIGMAS = 4.5  # standard deviations by which a sketch may underrate a pair; more happen once in 290,000 times
HELD = 1 << 22  # hashes that a task keeps of the texts it compared last
BEFORE = 2  # rows that each row of a bucket is compared with at first
WIDTH = 1.03  # sizes of sets are dealt to bins, each so many times as wide as the one below


def _word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The lowered words of a text, a block of about ``SLICE`` bytes at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0  # in bytes, lower and split only touch ASCII
    while at < len(data):
        space = SPACE.search(data, at + SLICE)
        to = space.start() if space else len(data)
        words = data[at:to].split()
        if words:
            yield words
        at = to


def _hashes(text: str | None, shingle: int, whole=None) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles, repeats included; a text of fewer words is one shingle.

    ``whole``, a hashlib object, is fed with the words and a blank after each.
    """
    digest, out, carry = xxhash.xxh64_intdigest, [], []
    for words in _word_blocks(text):
        if whole:
            whole.update(b" ".join(words) + b" ")
        words = carry + words
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(x + 1 for x in ends[:-1])]
        found = (digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :]))
        out.append(np.fromiter(found, np.uint64, len(words) - shingle + 1))
        carry = words[len(words) - shingle + 1 :]
    if not out and carry:
        return np.array([digest(b" ".join(carry), 42)], np.uint64)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(_hashes(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    """Per bit, whether over half of the hashes have it; 0 for none."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles as an unsigned number; 0 for a text without words."""
    return _majority(_hashes(text, shingle))


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as a signed long in ``out``; a null text counts as empty."""

    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, hashed(F.col(text_col)))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``src, dst`` of distinct fingerprints (``fp``, no repeats) that differ in ``radius`` bits or fewer.

    Multi-index hashing. The 64 bits fall into ``radius // 2 + 1`` segments (two at least), so
    that two linked fingerprints differ by one bit or none in some segment.
    Each fingerprint is stored once per segment, and looks up the ball of
    radius 1 around its own segment value. The ball only clears set bits: of
    two values one bit apart, one has that bit set, and that one does the
    looking. Matches are verified on all 64 bits. A fingerprint has at most
    43,744 others within three bits, and rows that share a fingerprint have
    been merged before, so links stay in proportion to the fingerprints.
    """
    parts = max(2, radius // 2 + 1)
    width = -(-BITS // parts)
    mask = (1 << width) - 1
    own = F.array(
        *[
            F.struct(
                F.lit(i).alias("part"),
                F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)).alias("value"),
            )
            for i in range(parts)
        ]
    )
    table = prints.select("fp", F.explode(own).alias("k")).select("k.part", "k.value", F.col("fp").alias("dst"))
    ball = F.expr(
        f"concat(array(value), transform(filter(sequence(0, {width - 1}), i -> (shiftright(value, i) & 1) = 1), "
        "i -> value & ~shiftleft(1L, i)))"
    )
    probes = table.select("part", F.explode(ball).alias("near"), "value", F.col("dst").alias("src"))
    met = probes.join(table.withColumnRenamed("value", "near"), ["part", "near"])
    return met.where(
        (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
        & ((F.col("near") != F.col("value")) | (F.col("src") < F.col("dst")))
    ).select("src", "dst")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``text_key``, ``fp`` (signed long), ``root`` and ``component_id``.

    ``component_id`` is the smallest ``id_col`` reachable over links of
    ``radius`` bits or fewer, ``root`` a number that the rows of one component
    share. Rows are merged by fingerprint before any join, so copies cost one
    row each. Null, empty and blank texts have fingerprint 0 and are linked
    with one another. Rows that repeat an id are kept as rows; a component
    whose ids are all null has a null ``component_id``. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = with_fingerprint(rows, "text", "fp", shingle).select("id", text_key(F.col("text")).alias("text_key"), "fp")
    marked = save(marked, "simhash")
    prints = save(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    joined = components(links(prints.select("fp"), radius))
    rooted = prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(rooted.select("fp", "root").join(least, "root"), "simhash-groups")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "text_key", "fp", "root", "component_id")


def _draws() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    n = BANDS * ROWS
    return r.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of shingles under each of ``BANDS * ROWS`` hash functions."""
    times, plus = _draws()
    least = np.full(len(times), ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        for i in range(len(times)):
            least[i] = min(least[i], (h * times[i] + plus[i]).min())
    return least


def bands(least: np.ndarray) -> list[int]:
    """A number for each band of ``ROWS`` least hashes, as signed longs."""
    raw = least.tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) - (1 << 63) for b in range(BANDS)]


def sketch(own: np.ndarray) -> bytes:
    """A byte for each of ``BINS`` ranges of hashes: it stands for the least of a set of shingles in it, 0 for none."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(own // np.uint64((1 << BITS) // BINS), return_index=True)
    out[bins.astype(np.int64)] = own[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


@F.pandas_udf(T.DoubleType())
def _sigmas(one: pd.Series, other: pd.Series, similarity: pd.Series) -> pd.Series:
    """By how many standard deviations the similarity of two sketches is below ``similarity``; 0 if there is nothing to tell by."""
    if one.empty:
        return pd.Series(dtype=np.float64)
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), BINS) for x in (one, other))
    n = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    s = similarity.to_numpy()
    short = s - ((a == b) & (a > 0)).sum(axis=1) / n
    return pd.Series(short / np.sqrt(np.maximum(s * (1 - s), 1e-9) / n))


def _beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by bucket: each row's node with those of up to ``BEFORE`` rows before it in its bucket."""
    last = pd.DataFrame({"bucket": [], "node": []}, dtype=np.int64)
    for pdf in batches:
        both = pd.concat([last, pdf[["bucket", "node"]]], ignore_index=True)
        bucket, node = both["bucket"].to_numpy(), both["node"].to_numpy()
        for k in range(1, BEFORE + 1):
            at = np.arange(max(k, len(last)), len(both))
            at = at[(bucket[at] == bucket[at - k]) & (node[at] != node[at - k])]
            yield pd.DataFrame({"src": np.minimum(node[at], node[at - k]), "dst": np.maximum(node[at], node[at - k])})
        last = both.tail(BEFORE).reset_index(drop=True)


def _bin(size) -> F.Column:
    return F.floor(F.log(size) / F.log(F.lit(WIDTH)))


def _meeting(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``src < dst`` of nodes with different roots whose sets can have ``similarity``; none that have it is left out.

    ``sets`` has a row ``node, n, root, h`` for each of the ``n`` shingles of a
    node. Of these only shingles that two roots have can be shared. In an order
    common to all sets, the rarest first, what two sets share lies at or after the
    first shingle they share, so both must have enough left there (``rest``)
    for their sizes. That leaves each set a few of its rarest shingles to meet
    others by, each for a range of sizes. Rows outside the root that has the most
    rows of a shingle look for the others of it. Sets that differ from a
    large group by shingles of their own are left with none.
    """
    least = lambda n: F.lit(similarity) * n - 1e-6
    roots = sets.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    known = sets.join(roots.where("low <> high").select("h", "df"), "h")
    order = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("h"))
    lead = known.withColumn("rest", F.row_number().over(order)).where(F.col("rest") >= least(F.col("n")))
    lead = save(lead.select("h", "node", "n", "root", "rest", _bin(F.col("n")).alias("bin")), "rare-shingles")
    mains = lead.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
    mains = mains.groupBy("h").agg(F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mains = mains.where("roots > 1").select("h", F.col("main.root").alias("main"))
    one = lead.join(mains, "h").where("root <> main").select("h", "main", *[F.col(c).alias(f"src_{c}") for c in ("node", "n", "root", "rest")])
    # a set of src_n with src_rest left meets sets of up to this size
    most = F.least(F.col("src_n") / similarity, F.col("src_rest") * (1 + similarity) / similarity - F.col("src_n")) + 1e-3
    one = one.withColumn("bin", F.explode(F.sequence(_bin(least(F.col("src_n"))), _bin(F.greatest(most, least(F.col("src_n")))))))
    met = one.join(lead, ["h", "bin"]).where(
        (F.col("src_root") != F.col("root"))
        & (F.least("src_rest", "rest") >= F.lit(similarity / (1 + similarity)) * (F.col("src_n") + F.col("n")) - 1e-6)
        & ((F.col("root") == F.col("main")) | (F.col("src_node") < F.col("node")))
    )
    return met.select(F.least("src_node", "node").alias("src"), F.greatest("src_node", "node").alias("dst")).distinct()


def _apart(
    nodes: DataFrame,
    joined: DataFrame,
    shared: DataFrame,
    linked: DataFrame,
    similarity: float,
    sets: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs ``src < dst`` of candidates that are in different components of ``joined`` and can have ``similarity``.

    Candidates are the rows of ``shared`` (``bucket, node``) with one bucket, the
    nodes of one fingerprint, and those of two ``linked`` fingerprints. Buckets
    whose nodes are all in one component are left out. ``sets`` gives the
    shingles ``node, h`` of a table of nodes: with it, all nodes of the other
    buckets meet by their rarest shingles (``_meeting``), and no pair that has
    ``similarity`` is left out. Without it, nodes outside a bucket's largest
    component meet all others of the bucket that are of a fitting size, and their
    sketches tell which are far from ``similarity``.
    """
    kept = ["node", "n", "root"] + ([] if sets else ["sketch"])
    rooted = nodes.where("n > 0").select("fp", *[c for c in kept if c != "root"]).join(joined, "node", "left")
    rooted = save(rooted.withColumn("root", F.coalesce("root", "node")), "first-components")
    ends = save(rooted.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high")), "fingerprint-components")
    side = lambda x: ends.select(F.col("fp").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    crossed = linked.join(side("src"), "src").join(side("dst"), "dst")
    crossed = crossed.where("least(src_low, dst_low) <> greatest(src_high, dst_high)")
    crossed = crossed.withColumn("bucket", F.xxhash64("src", "dst"))
    prints = crossed.select("bucket", F.col("src").alias("fp")).union(crossed.select("bucket", F.col("dst").alias("fp")))
    prints = prints.union(ends.where("low <> high").select(F.xxhash64("fp").alias("bucket"), "fp"))
    placed = shared.select("bucket", "node").join(rooted, "node").select("bucket", *kept)
    placed = placed.union(prints.join(rooted, "fp").select("bucket", *kept))
    if sets:
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        apart = save(placed.join(mixed, "bucket", "left_semi").select(*kept).distinct(), "nodes-apart")
        return _meeting(save(sets(apart).join(apart, "node"), "shingles-apart"), similarity)
    groups = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    mains = groups.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mains = mains.where("roots > 1").select("bucket", F.col("main.root").alias("main"))
    apart = save(placed.join(mains, "bucket"), "buckets-apart")
    one = apart.where("root <> main").select("bucket", *[F.col(c).alias(f"src_{c}") for c in kept])
    met = one.join(apart, "bucket").where(
        (F.col("src_root") != F.col("root"))
        & (F.least("src_n", "n") / F.greatest("src_n", "n") >= similarity)
        & ((F.col("root") == F.col("main")) | (F.col("src_node") < F.col("node")))
    )
    met = met.where(_sigmas("src_sketch", "sketch", F.lit(similarity)) <= SIGMAS)
    return met.select(F.least("src_node", "node").alias("src"), F.greatest("src_node", "node").alias("dst")).distinct()


def similar(
    docs: DataFrame,
    similarity: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``text_key``, ``root`` and ``component_id`` over links of exact similarity.

    Two texts are linked if the Jaccard similarity of their sets of word
    shingles is ``similarity`` or more. Candidates come first from multi-index
    hashing of their fingerprints, within ``radius`` bits. That alone does not
    find all: texts at 0.8 differ in 10 bits on average and in 17 now and
    then, and segments small enough for it hold a few bits, which all texts
    share. So more candidates come from bands of least hashes. Texts equal but
    for case and white space are merged before. Within a bucket each row meets the
    two before it in the order of the next band, and the bucket's leader, the
    text whose buckets have the most rows in all: that is the middle of a
    group whose outer texts are only like the middle. Most of a group is then
    one component. What is still apart meets in a second pass (``_apart``): the
    texts of buckets, fingerprints and linked fingerprints whose components
    differ meet by their rarest shingles, which finds all pairs of them that have
    ``similarity``. So the work of a large bucket follows its rows, and no
    candidate is left out. Each is verified on the whole texts, so no link is
    wrong; what can be missed are texts that share no band.
    """

    @F.pandas_udf("struct<node: long, fp: long, bands: array<long>, n: long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            whole = hashlib.blake2b(digest_size=8)
            h = _hashes(t, shingle, whole)
            fp = _majority(h)
            node = int.from_bytes(whole.digest(), "big", signed=True)
            own = np.unique(h)
            least = least_hashes(own)
            out.append((node, fp - (fp >> 63 << 64), bands(least) if len(own) else [], len(own)))
        return pd.DataFrame(out, columns=["node", "fp", "bands", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.select("id", text_key(F.col("text")).alias("text_key"), marks("text").alias("m"))
    marked = save(marked.select("id", "text_key", "m.node", "m.fp", "m.bands", "m.n"), "marks")
    nodes = marked.groupBy("node").agg(
        F.min("id").alias("least"),
        F.min("text_key").alias("text_key"),
        *[F.first(c).alias(c) for c in ("fp", "bands", "n")],
    )
    nodes = save(nodes, "nodes")
    # texts of one fingerprint meet the least of them, and those of linked fingerprints meet one another
    firsts = nodes.where("size(bands) > 0").groupBy("fp").agg(F.min("node").alias("first"))
    firsts = save(firsts, "fingerprints")
    within = nodes.where("size(bands) > 0").join(firsts, "fp").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    ends = [firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in ("src", "dst")]
    linked = save(links(firsts.select("fp"), radius), "fingerprint-links")
    near = linked.join(ends[0], "src").join(ends[1], "dst")
    near = near.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")).union(within)
    turned = F.expr("transform(bands, (x, i) -> struct(x as bucket, bands[(i + 1) % size(bands)] as next))")
    dealt = nodes.select("node", F.explode(turned).alias("b")).select("b.bucket", "b.next", "node")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = save(dealt.join(sizes, "bucket"), "buckets")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = shared.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("leader"))
    led = shared.where(f"n > {BEFORE + 1}").join(leaders.select("bucket", F.col("leader.node").alias("dst")), "bucket")
    led = led.where("node <> dst").select(F.col("node").alias("src"), "dst")
    ranked = shared.select("bucket", "next", "node").repartition("bucket").sortWithinPartitions("bucket", "next", "node")
    pairs = ranked.mapInPandas(_beside, "src long, dst long").union(led).union(near)
    pairs = save(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")

    @F.pandas_udf(T.BooleanType())
    def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, text: str) -> np.ndarray:
            nonlocal held
            if node not in sets:
                sets[node] = shingle_set(text, shingle)
                held += len(sets[node])
                while held > HELD and len(sets) > 1:
                    held -= len(sets.pop(next(iter(sets))))
            return sets[node]

        for columns in batches:
            out = []
            for src, one, dst, other in zip(*columns):
                a, b = of(src, one), of(dst, other)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both / (len(a) + len(b) - both) >= similarity)
            yield pd.Series(out, dtype=bool)

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts])

    def texts_of(some: DataFrame) -> DataFrame:
        met = nodes.select("node", "text_key").join(some, "node", "left_semi")
        texts = rows.select(text_key(F.col("text")).alias("text_key"), "text").join(met, "text_key")
        return texts.select("node", "text").dropDuplicates(["node"])

    def sets(some: DataFrame) -> DataFrame:
        return texts_of(some).select("node", F.explode(shingles("text")).alias("h"))

    def verified(pairs: DataFrame) -> DataFrame:
        texts = save(texts_of(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()), "pair-texts")
        both = pairs.join(texts.withColumnsRenamed({"node": "src", "text": "one"}), "src")
        both = both.join(texts.withColumnsRenamed({"node": "dst", "text": "other"}), "dst")
        return save(both.where(alike("src", "one", "dst", "other")).select("src", "dst"), "similar-links")

    found = verified(pairs)
    joined = components(found)
    more = save(_apart(nodes, joined, shared, linked, similarity, sets).join(pairs, ["src", "dst"], "left_anti"), "pairs-apart")
    if not more.isEmpty():
        joined = components(found.union(verified(more)))
    rooted = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(rooted.select("node", "root").join(least, "root"), "similar-groups")
    return marked.join(named, "node").select(F.col("id").alias(id_col), "text_key", "root", "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    similarity: float | None = None,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one with the smallest id.

    Components are those of ``similar`` where ``similarity`` is given, else of ``near_duplicates``.
    A component whose ids are all null keeps one of its rows; so does an id
    that repeats within its component.
    """
    if similarity is None:
        groups = near_duplicates(docs, id_col, text_col, shingle, radius)
    else:
        groups = similar(docs, similarity, id_col, text_col, shingle, radius)
    own = lambda key, i: text_key(F.concat(F.hex(key), F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit(""))))
    stay = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root")
    stay = stay.agg(F.min(F.struct("text_key", id_col)).alias("one"))
    name = fresh("_q_row", docs)
    stay = save(stay.select(own(F.col("one.text_key"), F.col(f"one.{id_col}")).alias(name)), "kept")
    # one key for the join and for the rows that repeat, so that texts are moved once
    keyed = docs.withColumn(name, own(text_key(F.col(text_col)), F.col(id_col)))
    return keyed.join(stay, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
