"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fresh

BLOCK = 512  # symbols that a lane parses; a phrase goes on into the next block
LANES = 4096  # blocks that are parsed side by side
BLANK, PAD = 0, 1
LETTERS = 46  # most frequent letters of the labelled text that have a symbol of their own
SPELLED = 16  # symbols that spell every other letter, three for each
RESULT = "lang string, score double, phrases array<long>"
_MODELS: dict[str, Model] = {}


@dataclass
class Model:
    """Automaton tables by language. An entry is 2 * (next state * symbols) plus 1 where a new phrase begins."""

    names: list[str]
    symbols: np.ndarray  # of each character below 65,536; PAD: spelled
    tables: list[np.ndarray]
    weights: np.ndarray  # bits that a phrase costs: log2 of the labelled text's length
    width: int


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def symbols_of(text: str, symbols: np.ndarray) -> tuple[np.ndarray, bool]:
    """The text's symbols, with runs of anything but letters as one blank; whether it has a letter.

    ``symbols`` has a symbol for each character below 65,536: of its own, the
    blank, or ``PAD`` for a letter that is spelled. Letters beyond are spelled.
    """
    codes = _codes(text)
    found = symbols[np.minimum(codes, len(symbols) - 1)]
    high = codes >= len(symbols)
    if high.any():
        found[high] = [PAD if chr(c).isalpha() else BLANK for c in codes[high].tolist()]
    blank = found == BLANK
    twice = blank.copy()
    twice[1:] &= blank[:-1]
    found, rare = found[~twice], (found == PAD)[~twice]
    if rare.any():
        c = codes[~twice][rare].astype(np.int64)
        c = c * 0x9E3779B1 >> 7 & 0xFFF  # twelve bits of a letter, four to a symbol
        first = int(symbols.max()) + 1
        at = np.repeat(np.arange(len(found)), np.where(rare, 3, 1))
        spelled = np.repeat(rare, np.where(rare, 3, 1))
        found = found[at]
        found[spelled] = first + np.stack([c >> 8, c >> 4 & 15, c & 15], axis=1).ravel()
    return found, not blank.all()


def suffix_automaton(line: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the smallest automaton that accepts all substrings of ``line``; state 0 is its start."""
    out: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in line:
        new = len(out)
        out.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(out)
                out.append(dict(out[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return out


def _table(line: np.ndarray, width: int) -> np.ndarray:
    states = suffix_automaton(line.tolist())
    start = np.ones(width, np.int32)
    for c, to in states[0].items():
        start[c] = 2 * to * width + 1
    table = np.tile(start, (len(states), 1))  # where no transition leads on, a phrase begins at the start state
    for s, row in enumerate(states):
        for c, to in row.items():
            table[s, c] = 2 * to * width
    table[:, PAD] = 2 * width * np.arange(len(states))
    return table.ravel()


def build(labelled: dict[str, str]) -> Model:
    """The model of some labelled text per language."""
    letters = _letters()
    counts: Counter[int] = Counter()
    for text in labelled.values():
        counts.update(c for c in _codes(text).tolist() if c < len(letters) and letters[c])
    symbols = np.where(letters, PAD, BLANK).astype(np.uint8)
    ranked = sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS]
    for i, c in enumerate(ranked):
        symbols[c] = PAD + 1 + i
    names = sorted(labelled)
    width = PAD + 1 + len(ranked) + SPELLED
    lines = [symbols_of(labelled[n], symbols)[0] for n in names]
    weights = np.array([max(1.0, np.log2(max(2, len(x)))) for x in lines])
    return Model(names, symbols, [_table(x, width) for x in lines], weights, width)


def phrases(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each language's automaton cuts each text into (texts x languages), and whether it has letters."""
    lines, lettered = [], np.zeros(len(texts), bool)
    total = np.zeros((len(texts), len(model.names)), np.int64)
    held = 0
    first = 0
    for i, t in enumerate(texts):
        line, lettered[i] = symbols_of(t, model.symbols) if t else (np.empty(0, np.uint8), False)
        lines.append(line)
        held += len(line)
        if held >= LANES * BLOCK or i == len(texts) - 1:
            _parse(lines, first, total, model)
            lines, held, first = [], 0, i + 1
    return total, lettered


def _walk(table: np.ndarray, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of each lane, and the phrases begun so far."""
    states, begun = np.empty(grid.shape, np.int32), np.empty(grid.shape, np.int32)
    count = np.zeros(len(state), np.int32)
    for i, row in enumerate(grid):
        entry = table[state + row]
        count = count + (entry & 1)
        state = entry >> 1
        states[i], begun[i] = state, count
    return states, begun


def _mend(table: np.ndarray, grid: np.ndarray, states: np.ndarray, begun: np.ndarray, lanes: np.ndarray, enter: np.ndarray) -> None:
    """Walks ``lanes`` again from the states in ``enter``, each until it meets the walk that is there."""
    count = np.zeros(len(lanes), np.int32)
    for i, row in enumerate(grid):
        entry = table[enter + row[lanes]]
        count = count + (entry & 1)
        enter = entry >> 1
        met = enter == states[i, lanes]
        if met.any():  # from here on both go the same way
            there = lanes[met]
            begun[i:, there] += count[met] - begun[i, there]
            lanes, enter, count = lanes[~met], enter[~met], count[~met]
        if not len(lanes):
            return
        states[i, lanes], begun[i, lanes] = enter, count


def _parse(lines: list[np.ndarray], first: int, total: np.ndarray, model: Model) -> None:
    """Adds the phrases of each line. Its blocks are walked side by side, each as if a phrase began there, and then mended:

    a block is walked again from where the one before it ended, until both
    walks are in one state, mostly within a few phrases. Where that changes the
    block's own end, the next one is mended in turn.
    """
    sizes = np.array([len(x) for x in lines])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(lines)), blocks)
    if not len(owner):
        return
    flat = np.concatenate(lines)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = starts + nth * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
    ends = np.zeros(len(model.tables), np.int32)  # where the lane before this slice ended
    for at in range(0, len(owner), LANES):
        s, n, who, later = (x[at : at + LANES] for x in (starts, length, owner, nth))
        steps = np.arange(int(n.max()))[:, None]
        grid = np.where(steps < n, flat[np.minimum(s + steps, len(flat) - 1)], PAD).astype(np.int32)
        for k, table in enumerate(model.tables):
            states, begun = _walk(table, grid, np.zeros(len(s), np.int32))
            inner, known = np.flatnonzero(later > 0), np.zeros(len(s), np.int32)
            while len(inner):
                before = np.concatenate([ends[k : k + 1], states[-1, :-1]])[inner]
                new = before != known[inner]
                inner, before = inner[new], before[new]
                known[inner] = before
                old = states[-1, inner].copy()
                _mend(table, grid, states, begun, inner, before)
                inner = inner[states[-1, inner] != old] + 1
                inner = inner[inner < len(s)]
                inner = inner[later[inner] > 0]
            ends[k] = states[-1, -1]
            np.add.at(total[:, k], who + first, begun[-1] + (later == 0))


def _fitting(rows: list[str], budget: int) -> str:
    """Whole texts in their order, as far as the budget has room for each."""
    out, left = [], budget
    for t in rows:
        if len(t) + 1 <= left:
            out.append(t)
            left -= len(t) + 1
    return "\n".join(out)


def labelled_text(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, chars_per_lang: int
) -> dict[str, str]:
    """At most ``chars_per_lang`` characters of labelled text per language, as whole texts picked by a hash of their id."""
    rank = Window.partitionBy("lang").orderBy("h", "text")
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) < chars_per_lang)).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
        F.col(text_col).alias("text"),
    )
    # docs_per_lang rows a language, each below chars_per_lang
    picked = rows.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= docs_per_lang)
    by: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "rn").toLocalIterator():
        by.setdefault(r["lang"], []).append(r["text"])
    out = {k: _fitting(v, chars_per_lang) for k, v in by.items()}
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


def identify(
    docs: DataFrame,
    learn_from: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 64,
    chars_per_lang: int = 32_000,
    out: str = "language",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``lang``, ``score`` and the phrases by language in the order of their names.

    ``learn_from`` gives the labelled text, at most ``docs_per_lang`` rows and
    ``chars_per_lang`` characters of each language: whole texts, so one that is
    longer than what is left of that is passed over. The most frequent letters
    have a symbol each, every other letter is spelled with three, so no script
    falls together into one letter. A language's suffix
    automaton follows a text as long as what it has read since the phrase
    began occurs in that language's text; then a new phrase begins. The
    language whose phrases cost the fewest bits in all, at log2 of its text's
    length each, wins; ties go to the first name. The whole text is parsed, and
    phrases are as long as they are. The score is the runner-up's part in both costs
    (0.5: a tie). A null text, one without letters, or a model without
    languages gives ``und`` and score 0. Only the text decides. No shuffle
    beyond the sample's; repeated rows and further columns pass through, and a
    column named as ``out`` is replaced.
    """
    labelled = labelled_text(learn_from, id_col, text_col, lang_col, docs_per_lang, chars_per_lang)
    name = hashlib.sha256(repr(sorted(labelled.items())).encode("utf-8", "surrogatepass")).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(labelled)  # bounded by the two parameters

    @F.pandas_udf(RESULT)
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = build(sent.value)
        model = _MODELS[name]
        for texts in batches:
            found, lettered = phrases(texts.tolist(), model)
            if not model.names:
                yield pd.DataFrame({"lang": "und", "score": 0.0, "phrases": [[]] * len(texts)}, index=texts.index)
                continue
            cost = found * model.weights
            best = cost.argmin(axis=1)
            low = cost[np.arange(len(cost)), best]
            rest = cost.copy()
            rest[np.arange(len(cost)), best] = np.inf
            second = rest.min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(np.isinf(second), 1.0, second / (second + low))
            yield pd.DataFrame(
                {
                    "lang": np.where(lettered, np.array(model.names, object)[best], "und"),
                    "score": np.where(lettered, score, 0.0),
                    "phrases": list(found),
                }
            )

    return docs.withColumn(out, named(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language was recognised, with their columns."""
    own = fresh("_q_language", docs)
    found = identify(docs, docs.where(~held_out(id_col)), id_col, text_col, lang_col, out=own, **options)
    return found.where(F.col(f"{own}.lang") != "und").select(*docs.columns)
