"""Text expressions. White space is what Unicode calls so, which the JVM's ``\\s`` alone does not cover."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u0085\p{Z}\x1c-\x1f]"
TAG = "<[^>]+>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def plain(html: Column) -> Column:
    """Text without tags, each of which counts as a blank; null gives an empty text."""
    return collapse(F.regexp_replace(F.coalesce(html, F.lit("")), TAG, " "))


def word_count(html: Column) -> Column:
    return let(plain(html), lambda words: F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).cast("long"))


def summary(text: Column) -> Column:
    """One sentence: white space collapsed, first letter upper case, one period at the end; null if nothing is left."""

    def sentence(one: Column) -> Column:
        whole = F.concat(F.upper(F.substring(one, 1, 1)), F.substr(one, F.lit(2)))
        return F.when(one != "", F.concat(F.regexp_replace(whole, "[ .]+$", ""), F.lit(".")))

    return let(collapse(text), sentence)


def descriptors(terms: Column) -> Column:
    """Trimmed, lower-case, non-empty terms."""
    return F.filter(F.transform(terms, lambda t: F.lower(strip(t))), lambda t: t != "")


def flipped_name(entry: Column) -> Column:
    """``Last, First, 1802-1870 [note]`` as ``First Last``; null if nothing is left."""
    bare = strip(F.regexp_replace(entry, r"\[.*?\]", ""))
    parts = F.transform(F.split(bare, ","), strip)
    dated = F.try_element_at(parts, F.lit(-1)).rlike("^[0-9]")
    parts = F.when(dated, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(bare == "", None).when(F.size(parts) >= 2, F.concat_ws(" ", second, first)).otherwise(first)


def parts_of(text: Column, by: str = ";") -> Column:
    """The non-empty, trimmed parts of a text."""
    return F.filter(F.transform(F.split(text, by), strip), lambda p: p != "")


def subjects(text: Column) -> Column:
    return F.array_sort(F.array_distinct(parts_of(F.coalesce(text, F.lit("")))))


def display_date(text: Column) -> Column:
    """``2008-06-07`` as ``June 7, 2008``; empty gives null, anything else that is no date is an error."""
    day = strip(text)
    return F.when(day != "", F.date_format(F.to_date(day, "yyyy-MM-dd"), "MMMM d, yyyy"))


def position(scene_id: Column) -> Column:
    """The number after the last hyphen, null where there is none."""
    return F.when(scene_id.contains("-"), F.substring_index(scene_id, "-", -1).try_cast("int"))


def uuid5(name: Column, namespace: uuid.UUID) -> Column:
    """The version 5 UUID of a name, from SHA-1 alone."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
