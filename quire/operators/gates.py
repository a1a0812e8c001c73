"""Gates that decide which books and records go on, and the checks of what a labeller returned."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.vocabulary import DRAMA_WORDS, OTHER_SHARE, RIGHTS


def drama_subjects(subjects: Column) -> Column:
    """The subjects that hold one of the drama words anywhere, sorted."""
    return F.array_sort(F.filter(subjects, lambda s: F.lower(s).rlike("|".join(DRAMA_WORDS))))


def book_gate(rights: Column, subjects: Column) -> Column:
    """Why a book is left out: its rights first, then its subjects; null if it goes on."""
    return F.when(~rights.eqNullSafe(F.lit(RIGHTS)), "rights").when(F.size(drama_subjects(subjects)) > 0, "subjects")


def gate_detail(reason: Column, rights: Column, subjects: Column) -> Column:
    """What a book was left out for: the rights it states, or the subjects that were met."""
    return F.when(reason == "rights", F.coalesce(rights, F.lit("none stated"))).when(
        reason == "subjects", F.array_join(drama_subjects(subjects), "; ")
    )


def share_of_other(labels: DataFrame) -> DataFrame:
    """Per book: paragraphs in noise, kept and other ranges, the share of other ones, and whether the book passes."""
    n = F.col("end_paragraph_index") - F.col("start_paragraph_index") + 1
    noise = F.coalesce(F.col("paragraph_type") == "noise", F.lit(False)) | F.coalesce(F.col("title") == "NOISE", F.lit(False))
    other = ~noise & F.coalesce(F.col("content_form") == "other", F.lit(False))
    total = lambda rows: F.coalesce(F.sum(F.when(rows, n)), F.lit(0)).cast("long")
    sums = labels.groupBy("book_id").agg(total(noise).alias("noise"), total(~noise).alias("kept"), total(other).alias("other"))
    share = F.when(F.col("kept") > 0, F.col("other") / F.col("kept")).otherwise(0.0)
    return sums.withColumn("other_share", share).withColumn("passes", F.col("other_share") <= OTHER_SHARE)


def pending(inputs: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Inputs that have no row in ``done`` yet."""
    return inputs.join(done.select(key), key, "left_anti")


def enriched(flag: Column, summary: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) & (F.coalesce(summary, F.lit("")) != "")


def indexable(summary: Column) -> Column:
    return F.coalesce(summary, F.lit("")) != ""


def coverage(expected: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Per ``key``: which of its expected indices no range covers, which covered ones were not expected, which are covered twice.

    ``expected`` has ``key, idx``; ``ranges`` ``key, start, end``. A range that
    ends before it starts covers nothing.
    """
    covered = ranges.where(F.col("end") >= F.col("start")).select(
        key, F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("idx")
    )
    counts = covered.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("times"))
    wanted = expected.select(key, F.col("idx").cast("long").alias("idx"), F.lit(True).alias("wanted")).distinct()
    both = wanted.join(counts, [key, "idx"], "full")
    places = lambda rows: F.array_sort(F.collect_list(F.when(rows, F.col("idx"))))
    found = both.groupBy(key).agg(
        places(F.col("times").isNull()).alias("missing"),
        places(F.col("wanted").isNull()).alias("extra"),
        places(F.col("times") > 1).alias("repeated"),
    )
    return found.withColumn("valid", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("repeated") == 0))


def expected_indices(payload: Column) -> Column:
    """Indices of the indexed paragraphs in a labelling payload."""
    return F.transform(
        F.from_json(payload, "indexed_paragraphs array<struct<index: int>>")["indexed_paragraphs"], lambda p: p["index"]
    )


def _places(payload: str, listed: str) -> list[int]:
    return [p["index"] for p in json.loads(payload).get(listed) or []]


def uncovered(payload: str, answer: str) -> str | None:
    """What is wrong with a labeller's answer: each indexed paragraph must lie in exactly one range, and no other number in any."""
    try:
        spans = [(int(r["start_paragraph_index"]), int(r["end_paragraph_index"])) for r in json.loads(answer)["scenes_data"]]
    except (ValueError, KeyError, TypeError):
        return "it is not the agreed JSON"
    wanted = set(_places(payload, "indexed_paragraphs"))
    times = Counter(i for a, b in spans for i in range(a, min(b, a + len(wanted) + 1) + 1))
    wrong = {
        "left out": sorted(wanted - times.keys()),
        "named but not given": sorted(times.keys() - wanted),
        "in more than one range": sorted(i for i, n in times.items() if n > 1),
    }
    told = [f"{what}: {where}" for what, where in wrong.items() if where]
    return "paragraphs " + "; ".join(told) if told else None
