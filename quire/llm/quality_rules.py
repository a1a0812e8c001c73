"""Quality rules by cross-document line frequency.

Normalised lines are hashed with their host; the distinct documents of a host
that have a line are counted; lines above the limit are removed, and documents
of which too little is left are rejected. Documents that fail plain rules of
their own text are rejected as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import save

#: The symbols that are counted, and what separates words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
NO_CHARACTER = bytes(range(0x80, 0xC0)) + SPACES  # bytes that begin no character of a word
MIN_WORDS = 50
MAX_REPEATED = 50  # of 100 words
MAX_DOCS = 25  # documents of a host that may share a line
MIN_LEFT = 0.3  # of a document's words
SALTS = 16
SLICE = 1 << 20  # bytes that are cut into words at a time

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "key binary, lines array<binary>, line_words array<long>"
)


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text, cut where it has white space."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end]
        at = end


def repeated_words(text: bytes) -> tuple[int, int]:
    """(words of a text, those in 3-word windows that it has twice or more)."""
    numbers: dict[bytes, int] = {}
    cut = [np.array([numbers.setdefault(w, len(numbers)) for w in part.split()], np.int64) for part in _slices(text)]
    words = np.concatenate(cut) if cut else np.empty(0, np.int64)
    if len(words) < 4:
        return len(words), 0
    _, pairs = np.unique(words[:-1] * len(numbers) + words[1:], return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * len(numbers) + words[2:], return_inverse=True, return_counts=True)
    twice = times[windows] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return len(words), int(covered.sum())


def _normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _line_key(host: bytes, line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(host + b"\n" + line)


def _host(value) -> bytes:
    return b"-" if value is None else b"=" + bytes(value)


def _features(text: bytes, host: bytes) -> tuple:
    n_words, n_repeated = repeated_words(text)
    lines: dict[bytes, int] = {}
    had: set[bytes] = set()
    n_dup = 0
    for line in text.split(b"\n"):
        plain = _normalised(line)
        if plain:
            digest = xxhash.xxh3_128_digest(line)
            n_dup += digest in had
            had.add(digest)
            lines[plain] = lines.get(plain, 0) + plain.count(b" ") + 1
    return (
        n_words,
        len(text.translate(None, NO_CHARACTER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        n_dup,
        n_repeated,
        xxhash.xxh3_128_digest(text),
        [_line_key(host, plain) for plain in lines],
        list(lines.values()),
    )


def _read(texts: pd.Series, hosts: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return pd.DataFrame([_features(b"" if t is None else bytes(t), _host(h)) for t, h in zip(texts, hosts)], columns=names)


def _without(texts: pd.Series, hosts: pd.Series, common: pd.Series) -> pd.Series:
    """Texts without the lines whose keys are listed."""

    def rest(text, host, keys) -> str:
        gone, own = {bytes(k) for k in (keys if keys is not None else ())}, _host(host)
        stays = lambda line: not (plain := _normalised(line)) or _line_key(own, plain) not in gone
        return b"\n".join(line for line in bytes(text or b"").split(b"\n") if stays(line)).decode()

    return pd.Series([rest(*x) for x in zip(texts, hosts, common)], dtype=object)


def _judged(docs: DataFrame, text: str, host: str, doc: Column, max_docs: int, min_words: int, min_left: float) -> DataFrame:
    """``doc``, ``common`` (keys of the document's lines above the limit, or null) and ``quality`` of each row."""
    features = F.pandas_udf(_read, FEATURES)(F.col(f"`{text}`").cast("binary"), F.col(f"`{host}`").cast("string").cast("binary"))
    seen = save(docs.select(F.monotonically_increasing_id().alias("r"), doc.alias("doc"), features.alias("f")), "lines")
    each = seen.select("r", "f.key", F.explode(F.arrays_zip("f.lines", "f.line_words")).alias("x"))
    each = each.select("r", "key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    shared = each.select("line", "key").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("docs"))
    shared = save(shared.where(F.col("docs") > max_docs).select("line"), "shared")
    # a line may be in a third of all documents: its rows are dealt to SALTS keys, and the few lines above the limit repeated
    salted = each.withColumn("salt", F.pmod("r", F.lit(SALTS)))
    common = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gone = salted.join(common, ["line", "salt"]).groupBy("r").agg(
        F.collect_list("line").alias("common"), F.sum("words").alias("gone")  # lines of one document
    )
    n, repeated = F.col("f.n_words"), F.col("f.n_repeat_words")
    left = n - F.coalesce("gone", F.lit(0).cast("long"))
    failed = (n < min_words) | (100 * repeated > MAX_REPEATED * n)
    quality = F.struct(
        *[f"f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_left * n)).alias("kept"),
        F.coalesce(F.size("common"), F.lit(0)).cast("long").alias("n_common_lines"),
        left.alias("n_left_words"),
    )
    return seen.join(gone, "r", "left").select("doc", "common", quality.alias("quality"))


def screen(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT,
) -> DataFrame:
    """``id`` and the struct ``quality``, one row for each row of ``docs``.

    ``n_words`` to ``n_repeat_words`` describe the text alone; ``base_failed``:
    it has under ``min_words`` words, or more than half of them lie in 3-word
    windows that it has twice. A line, with letters A-Z in lower case and white
    space collapsed, is common if more than ``max_docs`` different texts of its
    host have it (copies of one text are one document; all rows are counted,
    rejected ones too). ``n_common_lines`` of the document's different lines
    are, and without them it has ``n_left_words`` words. It is ``kept`` if it
    has not failed and ``min_words`` words and ``min_left`` of its words are left.

    A null text is an empty one and fails. A null host is a host of its own.
    Repeated rows have a row each; an empty table has none. Lines are held by
    128-bit digests. Other columns are not looked at, whatever their names.
    """
    judged = _judged(docs, text, host, F.struct(F.col(f"`{id}`").alias("id")), max_docs, min_words, min_left)
    return judged.select(F.col("doc.id").alias(id), "quality")


def clean(
    docs: DataFrame, text: str = "text", host: str = "source",
    max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT,
) -> DataFrame:
    """The rows that ``screen`` keeps, with their common lines cut out of the texts; all columns stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = _judged(docs, text, host, whole, max_docs, min_words, min_left).where("quality.kept")
    rest = F.pandas_udf(_without, "string")(F.col(f"doc.`{text}`").cast("binary"), F.col(f"doc.`{host}`").cast("string").cast("binary"), F.col("common"))
    cut = F.when(F.col("common").isNull(), F.col(f"doc.`{text}`")).otherwise(rest)
    return kept.select(*[cut.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
