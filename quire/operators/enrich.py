"""Facets of scenes: batching, joining answers back, resets, and the vector index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.hooks import answered, embedded
from quire.functions.text import descriptors, plain, summary
from quire.functions.vocabulary import ARCS, BATCH_CHARS, INTENSITIES, N_DESCRIPTORS, TONES
from quire.operators.gates import enriched, indexable
from quire.operators.paragraphs import packed
from quire.operators.scenes import neighbor_tones

ANSWER = (
    "items array<struct<index: int, dominant_tone: string, intensity: string, arc: string, "
    "descriptors: array<string>, summary: string>>"
)
FACETS = {
    "tone": "dominant_tone", "next_tone": "next_tone", "prev_tone": "prev_tone",
    "descriptors": "descriptors", "intensity": "intensity", "arc": "arc",
}


def batched(scenes: DataFrame, order: str = "pos", limit: int = BATCH_CHARS) -> DataFrame:
    """Adds ``batch`` (from 1) and ``index`` (from 0 in the batch): greedy batches of a book's scenes by plain text size."""
    dealt = packed(scenes, ["book_id"], order, F.length(plain(F.col("text_html"))), limit)
    first = dealt.groupBy("book_id", "part").agg(F.sort_array(F.collect_list(order)).alias("_all"))
    placed = first.select("book_id", F.col("part").alias("batch"), F.posexplode("_all").alias("index", order))
    return scenes.join(placed, ["book_id", order])


def payloads(batches: DataFrame) -> DataFrame:
    """``book_id, batch, payload``: the JSON that an enricher gets for each batch."""
    scene = F.struct(
        "index", "scene_title", "chapter_title", plain(F.col("text_html")).alias("text")
    )
    body = F.struct(F.array_sort(F.collect_list(scene)).alias("scenes"))
    return batches.groupBy("book_id", "batch").agg(F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def normalised(items: DataFrame) -> DataFrame:
    """Answered items with clean descriptors and summary, and ``valid``: all of the vocabulary, five descriptors, a summary."""
    clean = items.withColumn("descriptors", descriptors(F.col("descriptors"))).withColumn("summary", summary(F.col("summary")))
    fits = (
        F.col("dominant_tone").isin(TONES)
        & F.col("intensity").isin(INTENSITIES)
        & F.col("arc").isin(ARCS)
        & (F.size("descriptors") == N_DESCRIPTORS)
        & F.col("summary").isNotNull()
    )
    return clean.withColumn("valid", F.coalesce(fits, F.lit(False)))


def unfit(payload: str, answer: str) -> str | None:
    """What is wrong with an enricher's answer: one item for each scene, every facet from its vocabulary, five descriptors, a summary."""
    try:
        items = json.loads(answer)["items"]
        told = [int(i["index"]) for i in items]
        wanted = [s["index"] for s in json.loads(payload)["scenes"]]
        if sorted(told) != sorted(wanted):
            return f"scenes {sorted(wanted)} need one item each, and there are items for {sorted(told)}"
        for i in items:
            for name, words in (("dominant_tone", TONES), ("intensity", INTENSITIES), ("arc", ARCS)):
                if i[name] not in words:
                    return f"item {i['index']}: {name} {i[name]!r} is none of {', '.join(words)}"
            if len([d for d in i["descriptors"] if d.strip()]) != N_DESCRIPTORS:
                return f"item {i['index']} needs {N_DESCRIPTORS} descriptors"
            if not i["summary"].strip():
                return f"item {i['index']} has no summary"
    except (ValueError, KeyError, TypeError, AttributeError):
        return "it is not the agreed JSON"
    return None


def told(batches: DataFrame, enricher: Callable, check: Callable | None = unfit, **options) -> DataFrame:
    """``book_id, batch, payload, answer, failure``: what the enricher says to each batch, asked again while ``check`` refuses it."""
    return answered(payloads(batches), enricher, ANSWER, check, **options)


def facets(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """``scene_id``, its facets, and ``failure``: one row for each scene of the batches.

    A scene of a batch without a valid answer, without an item of its own or
    with one that is not valid has null facets and the reason in ``failure``.
    """
    items = answers.select("book_id", "batch", F.explode("answer.items").alias("i")).select("book_id", "batch", "i.*")
    items = normalised(items.dropDuplicates(["book_id", "batch", "index"]))
    why = answers.select("book_id", "batch", F.col("failure").alias("_why"))
    rows = batches.select("book_id", "batch", "index", "scene_id").join(items, ["book_id", "batch", "index"], "left")
    rows = rows.join(why, ["book_id", "batch"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    names = ["dominant_tone", "intensity", "arc", "descriptors", "summary"]
    failure = F.when(~F.col("valid"), F.coalesce("_why", F.when(F.col("summary").isNull() & F.col("arc").isNull(), "no item").otherwise("facets out of vocabulary")))
    return rows.select("scene_id", *[F.when(F.col("valid"), F.col(n)).alias(n) for n in names], failure.alias("failure"))


def ask(batches: DataFrame, enricher: Callable, check: Callable | None = unfit, **options) -> DataFrame:
    """``scene_id``, its facets and ``failure`` for each scene of the batches, as the enricher gives them."""
    return facets(batches, told(batches, enricher, check, **options))


def applied(scenes: DataFrame, facets: DataFrame, model: str) -> DataFrame:
    """Scenes with their new facets; those without any, or with a ``failure``, keep what they had. Neighbours' tones are joined anew."""
    facets = facets.where("failure is null") if "failure" in facets.columns else facets
    names = ["dominant_tone", "intensity", "arc", "descriptors", "summary"]
    new = facets.select("scene_id", F.lit(True).alias("_new"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = scenes.join(new, "scene_id", "left")
    joined = joined.withColumns({n: F.when(F.col("_new"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names})
    joined = joined.withColumn("enriched", F.coalesce(F.col("_new"), F.col("enriched")))
    joined = joined.withColumn("enrich_model", F.when(F.col("_new"), F.lit(model)).otherwise(F.col("enrich_model")))
    return neighbor_tones(joined.drop("_new", *[f"_{n}" for n in names])).select(*scenes.columns)


def todo(scenes: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Scenes still to be enriched: not yet so, and not among those that an earlier, broken run has saved."""
    rest = scenes.where(~enriched(F.col("enriched"), F.col("summary")))
    return rest.join(done.select("scene_id"), "scene_id", "left_anti") if done is not None else rest


def reset(scenes: DataFrame, *facets: str) -> DataFrame:
    """Named facets (all without a name) as nulls; ``enriched`` stands for the summary and its marks."""
    out = scenes
    for name in facets or (*FACETS, "enriched"):
        if name == "enriched":
            out = out.withColumns({"summary": F.lit(None).cast("string"), "enriched": F.lit(False), "enrich_model": F.lit(None).cast("string")})
        else:
            column = FACETS[name]
            out = out.withColumn(column, F.lit(None).cast(out.schema[column].dataType))
    return out


def indexed(scenes: DataFrame, embed: Callable, embedding: Callable = embedded) -> DataFrame:
    """Scenes that have a summary, with vectors of it and of their descriptors (the summary again if there are none).

    ``embedding`` makes the vectors of a column: ``hooks.embedded``, or one that
    remembers them (``sources.tables.remembered``).
    """
    ready = scenes.where(indexable(F.col("summary")))
    terms = F.array_join("descriptors", ", ")
    ready = ready.withColumn("_terms", F.when(F.coalesce(terms, F.lit("")) != "", terms).otherwise(F.col("summary")))
    return embedding(embedding(ready, "summary", "summary_vec", embed), "_terms", "descriptors_vec", embed).drop("_terms")
