"""The flows from books to scenes and from scenes to an index.

``store`` keeps named tables and gives them back (``sources.tables.Store``): what a
model has answered is written once and only read afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.hooks import answered
from quire.operators import enrich, gates, paragraphs, relational, scenes, upsert
from quire.sources import archive, tables
from quire.sources.tables import Store

LABELS = (
    "scenes_data array<struct<start_paragraph_index: int, end_paragraph_index: int, paragraph_type: string, "
    "content_form: string, open_start_index: boolean, open_end_index: boolean, title: string>>"
)


def to_paragraphs(pages: DataFrame) -> DataFrame:
    """Numbered paragraphs of the pages' segments that are long enough."""
    return paragraphs.numbered(paragraphs.kept_segments(archive.paragraphs(pages)))


def told(chunks: DataFrame, labeller: Callable, check: Callable | None = gates.uncovered, **options) -> DataFrame:
    """``book_id, chunk_index, payload, answer, failure``: what the labeller says to each chunk, asked again while ``check`` refuses it."""
    return answered(paragraphs.labelling_payload(chunks), labeller, LABELS, check, **options)


def label(answers: DataFrame) -> DataFrame:
    """The ranges of a labeller's answers: ``book_id, ord`` and the fields of each range, in order of chunk and place."""
    cut = answers.select("book_id", "chunk_index", F.posexplode("answer.scenes_data").alias("place", "s"))
    return cut.select("book_id", F.struct("chunk_index", "place").alias("ord"), "s.*")


def to_scenes(
    numbered: DataFrame, metadata: DataFrame, rights: DataFrame, labeller: Callable, store: Store, done: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scene records, excluded books with ``reason`` and ``detail``): books are gated before any chunk goes to the labeller.

    Books of ``done`` (``book_id``) have their scenes already and are passed
    over. Answers are kept chunk by chunk: a run that is started again only
    asks for chunks that have no valid one. A book of which a chunk got no
    valid answer gives no scenes; it is listed as ``unlabelled`` with what was
    wrong. Scenes and the list of excluded books keep the books of earlier runs.
    The answers of books whose scenes are stored are dropped.
    """
    books = metadata.join(rights.withColumnRenamed("book_id", "ID"), "ID", "left")
    if done is not None:
        books = gates.pending(books, done.select(F.col("book_id").alias("ID")), "ID")
    reason = gates.book_gate(F.col("rights"), F.col("Subjects"))
    detail = gates.gate_detail(reason, F.col("rights"), F.col("Subjects"))
    gated = books.select(F.col("ID").alias("book_id"), reason.alias("reason"), detail.alias("detail"))
    passed = gated.where("reason is null").select("book_id")
    kept = numbered.join(passed, "book_id", "left_semi")
    answers = store.resumed(
        paragraphs.labelling_payload(paragraphs.chunks(kept)),
        "answers",
        ["book_id", "chunk_index", "payload"],
        lambda rows: answered(rows, labeller, LABELS, gates.uncovered),
    )
    answers = store(answers, "labelled")
    broken = answers.where("failure is not null").groupBy("book_id").agg(F.min("failure").alias("detail"))
    labels = store(label(answers.join(broken, "book_id", "left_anti")), "labels")
    shares = gates.share_of_other(labels)
    labels = labels.join(shares.where("passes").select("book_id"), "book_id", "left_semi")
    titled = kept.withColumn("chapter_title", F.col("heading"))
    other = shares.where("not passes").select("book_id", F.lit("other").alias("reason"), F.format_number("other_share", 3).alias("detail"))
    excluded = (
        gated.where("reason is not null").unionByName(other).unionByName(broken.withColumn("reason", F.lit("unlabelled")))
    )
    made = store.books(scenes.records(labels, titled, metadata), "scenes"), store.books(excluded, "excluded")
    store.clear("answers", gates.pending(answers.select("book_id").distinct(), broken, "book_id"))
    return made


def to_index(
    records: DataFrame, enricher: Callable, embed: Callable, model: str, store: Store, status: DataFrame | None = None, embedder: str = "1"
) -> tuple[DataFrame, DataFrame]:
    """(relational mirror of all scenes, indexed scenes): facets are asked for where they are missing.

    Answers are kept batch by batch, as those of ``to_scenes`` are. Scenes
    without a valid one stay as they were; the table ``facets`` names the failure.
    Books that ``status`` calls completed are not asked about; with it given,
    the table ``status`` has those whose scenes are all enriched now as well.
    Texts that ``embedder``, the version of ``embed``, has seen are not embedded
    again. The answers of books without a failure are dropped.
    """
    positioned = relational.mirror(records).select("scene_id", "pos")
    open_scenes = enrich.todo(records).join(positioned, "scene_id")
    if status is not None:
        open_scenes = gates.pending(open_scenes, status.where("status = 'completed'"), "book_id")
    batches = store(enrich.batched(open_scenes), "batches")
    answers = store.resumed(
        enrich.payloads(batches),
        "enrichments",
        ["book_id", "batch", "payload"],
        lambda rows: answered(rows, enricher, enrich.ANSWER, enrich.unfit),
    )
    facets = store(enrich.facets(batches, answers), "facets")
    full = store(enrich.applied(records, facets, model), "enriched")
    if status is not None:
        whole = gates.pending(full.select("book_id").distinct(), enrich.todo(full), "book_id")
        store(tables.written(tables.marked(status, whole), f"{store.folder}/status-next"), "status")
    vectors = tables.remembered(f"{store.folder}/vectors", embedder)
    made = relational.mirror(full), store(enrich.indexed(full, embed, vectors), "index")
    open_books = batches.join(facets.where("failure is not null"), "scene_id").select("book_id")
    store.clear("enrichments", gates.pending(batches.select("book_id").distinct(), open_books, "book_id"))
    return made


def reset_books(
    records: DataFrame, status: DataFrame, store: Store, *facets: str, books: list[str] | DataFrame | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """(records with the named facets cleared, status without the marks of their books, number of scenes cleared).

    All books, or those of ``books``, ids or a table with ``book_id``; ids that
    have no scenes change nothing. Both tables are written to the store.
    """
    if isinstance(books, list):
        books = records.sparkSession.createDataFrame([(b,) for b in books], "book_id string")
    chosen = records if books is None else records.join(books.select("book_id").distinct(), "book_id", "left_semi")
    rest = records.limit(0) if books is None else records.join(books.select("book_id").distinct(), "book_id", "left_anti")
    n = chosen.count()
    marks = tables.unmarked(status, chosen.select("book_id").distinct())
    cleared = enrich.reset(chosen.select(*records.columns), *facets).unionByName(rest.select(*records.columns))
    return store(cleared, "reset-scenes"), store(marks, "reset-status"), n


def refreshed(mirror: DataFrame, index: DataFrame | None, records: DataFrame, embed: Callable) -> tuple[DataFrame, DataFrame]:
    """The mirror and the index with ``records`` in place of their rows of the same ids.

    All records go to the mirror, those with a summary to the index. An index
    that has other vector columns than the new rows is left out and built anew.
    """
    rows = upsert.replaced(mirror, relational.mirror(records), ["scene_id"])
    fresh = enrich.indexed(records, embed)
    kinds = lambda df: {c for c, kind in df.dtypes if kind == "array<float>"}
    if index is None or kinds(index) != kinds(fresh):
        return rows, fresh
    return rows, upsert.merged(index, fresh, ["scene_id"], ["scene_id"])
