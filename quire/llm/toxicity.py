"""Toxicity scores of a convolutional text classifier."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, save

PREFIXES = (0, 6, 4)  # bytes of a word that are hashed; 0: all
PIECE = 1 << 15  # words that are convolved at once
LONG = 1 << 10  # words beyond which a text is learned from by its different windows
BATCH, RATE = 64, 0.01  # texts of a step, and its rate
PASSES, VISITS = (2, 12), 48_000  # over the labelled texts: so many that they make so many visits, within these bounds
BINS = 8192  # of scores, by which thresholds are found
CHUNK = 1 << 14  # numbers of a network that are averaged at once
_KEPT: dict[str, Network] = {}
#: A-Z to a-z; ASCII that is neither a letter nor a digit becomes a blank.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def hashed_words(text: str | None, buckets: int) -> np.ndarray:
    """Bucket numbers (words x prefixes) of a text's words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    crc = zlib.crc32
    out = np.empty((len(found), len(PREFIXES)), np.int32)
    for i, p in enumerate(PREFIXES):
        h = np.fromiter((crc(w[:p], p) if p else crc(w) for w in found), np.int64, len(found))
        out[:, i] = h % buckets
    return out


def windows_once(ids: np.ndarray, width: int) -> np.ndarray:
    """Bucket numbers of a long text without the places whose ``width`` words stand at an earlier place, too.

    Words that are kept only because a window before them needs them have their first
    number inverted. The greatest value of a filter stays what it is.
    """
    n = len(ids)
    if n <= LONG:
        return ids
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([ids.astype(np.int64), np.full((width - 1, ids.shape[1]), -1)]) + 2
    for j in range(width):
        for q in range(ids.shape[1]):
            key = (key + padded[j : j + n, q].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    start = np.zeros(n, bool)
    start[np.unique(key, return_index=True)[1]] = True
    keep = start.copy()
    for j in range(1, width):
        keep[j:] |= start[:-j]
    out = ids[keep]
    out[~start[keep], 0] ^= -1
    return out


def _own(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers as they are, and which rows begin no window of their text."""
    skip = ids[:, 0] < 0
    if skip.any():
        ids = ids.copy()
        ids[skip, 0] ^= -1
    return ids, skip


@dataclass
class Network:
    """Hashed word embeddings, convolutions of several widths, the maximum of each filter, one logistic unit."""

    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    seed: int = 7
    emb: np.ndarray = field(init=False, repr=False)
    conv: list[np.ndarray] = field(init=False, repr=False)
    bias: np.ndarray = field(init=False, repr=False)
    top: np.ndarray = field(init=False, repr=False)
    base: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.emb = r.normal(0, 0.1, (self.buckets, self.dim)).astype(np.float32)
        self.conv = [r.normal(0, 0.4, (w, self.dim, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = np.zeros(self.filters * len(self.widths), np.float32)
        self.top = r.normal(0, 0.3, self.filters * len(self.widths)).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def _pad(self) -> int:
        return max(self.widths) - 1

    def _maps(self, x: np.ndarray, n: int) -> np.ndarray:
        """Filter values at ``n`` positions of ``x``, which has the padding rows at its end."""
        return np.concatenate([sum(x[j : j + n] @ c[j] for j in range(len(c))) for c in self.conv], axis=1)

    def _embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.emb[ids[:, k]]
        return x

    def score(self, ids: np.ndarray) -> float:
        """The score of a whole text, whose maxima are taken piece by piece."""
        most = np.full(len(self.bias), -np.inf, np.float32)
        pad = np.zeros((self._pad(), self.dim), np.float32)
        for at in range(0, max(1, len(ids)), PIECE):
            part, skip = _own(ids[at : at + PIECE + self._pad()])
            x = self._embed(part)
            n = max(1, min(PIECE, len(ids) - at))
            x = np.concatenate([x, np.zeros((max(0, n + len(pad) - len(x)), self.dim), np.float32)])
            maps = self._maps(x, n)
            maps[: len(skip)][skip[:n]] = -np.inf
            most = np.maximum(most, maps.max(axis=0))
        z = float(np.maximum(most + self.bias, 0) @ self.top + self.base[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | float = 1.0) -> tuple[float, list[np.ndarray]]:
        """The mean weighted cross-entropy of some texts and its gradient for each parameter.

        Only the place of each filter's maximum passes its gradient on, so no
        more than a piece of the texts is convolved at once.
        """
        pad = self._pad()
        sizes = np.array([len(t) + pad + 1 for t in texts])
        ids = np.zeros((int(sizes.sum()) + pad, len(PREFIXES)), np.int32)
        real = np.zeros(len(ids), np.float32)
        starts = np.cumsum(sizes) - sizes
        for s, t in zip(starts, texts):
            ids[s : s + len(t)] = t
            real[s : s + len(t)] = 1
        ids, skip = _own(ids)
        n = int(sizes.sum())
        most = np.full((len(texts), len(self.bias)), -np.inf, self.emb.dtype)
        place = np.zeros(most.shape, np.int64)
        every = np.arange(len(self.bias))
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            maps = self._maps(self._embed(ids[a : b + pad]) * real[a : b + pad, None], b - a)
            maps[skip[a:b]] = -np.inf
            for d in range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b))):
                lo = max(int(starts[d]), a)
                own = maps[lo - a : min(int(starts[d] + sizes[d]), b) - a]
                at = own.argmax(axis=0)
                more = own[at, every] > most[d]
                most[d][more] = own[at, every][more]
                place[d][more] = (lo + at)[more]
        hidden = np.maximum(most + self.bias, 0)
        z = np.clip(hidden @ self.top + self.base[0], -40, 40)
        p = 1 / (1 + np.exp(-z))
        loss = float(np.mean(weights * (np.logaddexp(0, z) - labels * z)))
        dz = (weights * (p - labels) / len(texts)).astype(self.top.dtype)
        dh = dz[:, None] * self.top * (hidden > 0)
        g_emb = np.zeros_like(self.emb)
        g_conv = [np.zeros_like(c) for c in self.conv]
        at_rows, backs = [], []
        for k, c in enumerate(self.conv):
            own = dh[:, k * self.filters : (k + 1) * self.filters].ravel()
            kernel = np.tile(np.arange(self.filters), len(texts))
            for j in range(len(c)):
                rows = place[:, k * self.filters : (k + 1) * self.filters].ravel() + j
                back = own * real[rows]
                x = self._embed(ids[rows]) * back[:, None]
                g_conv[k][j] = x.reshape(len(texts), self.filters, self.dim).sum(axis=0).T
                used = np.flatnonzero(back)
                at_rows.append(rows[used])
                backs.append(c[j].T[kernel[used]] * back[used, None])
        at_rows, backs = np.concatenate(at_rows), np.concatenate(backs)
        for q in range(len(PREFIXES)):
            np.add.at(g_emb, ids[at_rows, q], backs)
        return loss, [g_emb, *g_conv, dh.sum(axis=0), hidden.T @ dz, np.array([dz.sum()], self.base.dtype)]

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, self.bias, self.top, self.base]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def untaught(self) -> None:
        """Without labels of both kinds nothing can be learned: every text gets the same low score."""
        self.top[:] = 0
        self.base[:] = -2


class Adam:
    """Steps of a network down the gradient of the cross-entropy."""

    def __init__(self, network: Network) -> None:
        self.network, self.step = network, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float) -> None:
        self.step += 1
        for param, g, (m, v) in zip(self.network.parameters(), self.network.gradients(texts, labels, weights)[1], self.moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            param -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


def threshold(toxic: np.ndarray, clean: np.ndarray, toxic_rows: np.ndarray | None = None, clean_rows: np.ndarray | None = None) -> float:
    """Where the balanced accuracy is best: halfway between that score and the one below it; of equal ones the lowest.

    Scores may stand for several rows each.
    """
    tries = np.unique(np.concatenate([toxic, clean, [0.5]]))

    def below(scores: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        order = np.argsort(scores)
        sums = np.concatenate([[0], np.cumsum((np.ones(len(scores), np.int64) if rows is None else rows)[order])])
        return sums[np.searchsorted(scores[order], tries)] / sums[-1]

    at = int(np.argmax(np.round(1 - below(toxic, toxic_rows) + below(clean, clean_rows), 12)))
    return float((tries[at] + tries[max(0, at - 1)]) / 2)


def _pass_over(rows: DataFrame, nets: dict[int, Network], weight: dict[int, float], seed: int, rate: float) -> None:
    """Each task trains the networks on its rows; what they changed is averaged over the tasks that changed it.

    Network ``k`` learns from the rows whose part is not ``k``. A task reads
    its rows once, some at a time.
    """
    sent = rows.sparkSession.sparkContext.broadcast(nets)  # buckets x dim floats each: fixed by their parameters

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adams = {k: Adam(replace(net).load(net.flat())) for k, net in sent.value.items()}
        r = np.random.default_rng(seed)
        for pdf in batches:
            ids = [np.asarray(x, np.int32).reshape(-1, len(PREFIXES)) for x in pdf["ids"]]
            y, part = pdf["label"].to_numpy(np.float32), pdf["part"].to_numpy()
            w = np.where(y > 0, weight[1], weight[0]).astype(np.float32)
            for k, adam in adams.items():
                order = r.permutation(np.flatnonzero(part != k))
                for who in np.split(order, range(BATCH, len(order), BATCH)) if len(order) else []:
                    adam.learn([ids[i] for i in who], y[who], w[who], rate)
        for k, adam in adams.items():
            if adam.step:
                change = adam.network.flat() - sent.value[k].flat()
                chunks = [change[at : at + CHUNK].tobytes() for at in range(0, len(change), CHUNK)]
                yield pd.DataFrame({"net": k, "chunk": range(len(chunks)), "change": chunks})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, 0
        for x in pdf["change"]:
            x = np.frombuffer(x, np.float32)
            total, n = total + x.astype(np.float64), n + (x != 0)
        pdf = pdf.head(1).copy()
        pdf["change"] = [(total / np.maximum(n, 1)).astype(np.float32).tobytes()]
        return pdf

    kind = "net int, chunk int, change binary"
    changes = rows.select("label", "part", "ids").mapInPandas(learn, kind).groupBy("net", "chunk").applyInPandas(mean, kind)
    found = changes.toPandas().sort_values(["net", "chunk"])  # as large as the networks
    for k, own in found.groupby("net"):
        nets[k].load(nets[k].flat() + np.frombuffer(b"".join(own["change"]), np.float32))
    sent.unpersist()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str | None = "lang",
    network: Network | None = None,
) -> tuple[Network, dict[str, float]]:
    """A network and one threshold per language, from all labelled texts.

    Tasks train on their rows and their networks are averaged after each pass
    over the whole table, so only networks come to the driver. The fewer rows, the
    more passes. Both labels weigh the same in all. Thresholds are found on the
    scores that each of ``folds`` parts, by a hash of the id, gets from a
    network trained on the others, counted in ``BINS`` bins. They are for
    the language of the row and never touch a score; a language without both
    labels has none. Of rows that repeat an id the least text counts, of labels the
    highest; null ids, labels and texts are not learned from. Without texts
    of both labels the network is left untaught.
    """
    network = network or Network()
    buckets, width = network.buckets, max(network.widths)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([windows_once(hashed_words(t, buckets), width).ravel() for t in texts])

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("label"))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.where(F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(known, "id").groupBy("id").agg(F.first("label").alias("label"), F.min(F.struct("text", "lang")).alias("row"))
    part = (F.crc32(F.concat(F.col("id").cast("string"), F.lit("fold"))) % folds).cast("int")
    rows = save(rows.select("label", "row.lang", part.alias("part"), hashed("row.text").alias("ids")), "labelled")
    counts = rows.groupBy("part", "label").count().toPandas()  # folds x 2
    n = [int(counts.loc[counts["label"] == one, "count"].sum()) for one in (0, 1)]
    thresholds: dict[str, float] = {}
    if not all(n):
        network.untaught()
        return network, thresholds
    taught = [k for k in range(folds) if counts.loc[counts["part"] != k, "label"].nunique() == 2]
    nets = {k: replace(network).load(network.flat()) for k in taught} | {-1: network}
    weight = {one: sum(n) / (2 * n[one]) for one in (0, 1)}
    passes = min(PASSES[1], max(PASSES[0], VISITS // sum(n)))
    for i in range(passes):
        _pass_over(rows, nets, weight, network.seed + i, RATE * min(1.0, 2 * (1 - i / passes)))
    sent = rows.sparkSession.sparkContext.broadcast({k: nets[k] for k in taught})

    @F.pandas_udf("int")
    def placed(parts: pd.Series, ids: pd.Series) -> pd.Series:
        own = sent.value
        scores = [own[k].score(np.asarray(x, np.int32).reshape(-1, len(PREFIXES))) for k, x in zip(parts, ids)]
        return pd.Series([min(BINS - 1, int(x * BINS)) for x in scores], dtype="int32")

    judged = rows.where(F.col("part").isin(taught) & F.col("lang").isNotNull())
    # at most BINS rows a language and label
    found = judged.groupBy("lang", "label", placed("part", "ids").alias("bin")).agg(F.count(F.lit(1)).alias("rows")).toPandas()
    for name, own in found.groupby("lang"):
        both = [own[own["label"] == one] for one in (1, 0)]
        if all(len(x) for x in both):
            scores = [(x["bin"].to_numpy() + 0.5) / BINS for x in both]
            thresholds[name] = threshold(*scores, *[x["rows"].to_numpy() for x in both])
    return network, thresholds


def score(
    docs: DataFrame, fitted: tuple[Network, dict[str, float]], text_col: str = "text", lang_col: str | None = "lang", out: str = "toxicity"
) -> DataFrame:
    """``docs`` with a struct ``out``: ``score`` (0 to 1) and ``flagged``, the score held against its language's threshold.

    Whole texts are scored inside the task that reads them: no shuffle. The
    text alone decides the score; null and empty texts get the score of no
    words. A language without a threshold, or none, uses 0.5. Repeated rows and
    further columns pass through, and a column named as ``out`` is replaced.
    """
    network, thresholds = fitted
    spark = docs.sparkSession
    name = hashlib.sha256(network.emb.tobytes() + network.top.tobytes()).hexdigest()
    sent = spark.sparkContext.broadcast(network)  # buckets x dim floats: fixed by its parameters

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = sent.value
        own = _KEPT[name]
        for texts in batches:
            yield pd.Series([own.score(hashed_words(t, own.buckets)) for t in texts], dtype="float64")

    limit = F.lit(0.5)
    for lang, at in thresholds.items() if lang_col else ():
        limit = F.when(F.col(lang_col) == lang, F.lit(at)).otherwise(limit)
    # the result's own column holds the score at first; a column of that name is replaced
    marked = docs.withColumn(fresh("_q_limit", docs), limit).withColumn(out, scored(F.col(text_col)))
    own = F.col(fresh("_q_limit", docs))
    flagged = marked.withColumn(out, F.struct(F.col(out).alias("score"), (F.col(out) >= own).alias("flagged")))
    return flagged.drop(fresh("_q_limit", docs))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
