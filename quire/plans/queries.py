"""Queries over the given tables, one or more for each operator, and the same in DuckDB SQL.

Documents stand in for books (a line is a paragraph), conversations for scenes
in reading order (a turn's role is its tone), embeddings for scene vectors.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import hooks, text, vectors
from quire.operators import enrich, gates, paragraphs, relational, scenes, search, spread, upsert, vector_index
from quire.plans import flow
from quire.sources import archive, books, catalog, layout, tables
from quire.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "quire.scenes")
PACK_CHARS = 2000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.numbered(paragraphs.lines(_t(spark, sf_dir, "documents"), "doc_id", "text"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("pos"), F.col("role").alias("dominant_tone"), "text"
    )
    return scenes.dense_neighbor_tones(scenes.linked(turns, "pos"))


WHITE = r"[\s\v\x{85}\p{Z}\x{1c}-\x{1f}]"
WHITE_ENDS = f"^{WHITE}+|{WHITE}+$"
LINES = """lines as (select cast(doc_id as varchar) as book_id, unnest(p) as text, unnest(range(len(p))) as para
  from (select doc_id, string_split(text, chr(10)) as p from documents)),
paras as (select book_id, text, row_number() over (partition by book_id order by para) - 1 as idx from lines where text <> '')"""
SCENES = """scenes as (select cast(conv_id as varchar) as book_id, turn as pos, role as dominant_tone, text,
  conv_id || '-' || turn as scene_id,
  lag(conv_id || '-' || turn) over w as prev_scene_id, lead(conv_id || '-' || turn) over w as next_scene_id,
  lag(role) over w as prev_tone, lead(role) over w as next_tone
  from conversations window w as (partition by conv_id order by turn))"""
# parts are at most 2,000 characters: the items of a part before a new one follow from a recursion over places
PACKED = """items as (select {group} as g, {order} as o, {size} as n, row_number() over (partition by {group} order by {order}) as rn from {table}),
packed as (
  with recursive walk(g, o, rn, size, part) as (
    select g, o, rn, n, 1 from items where rn = 1
    union all
    select i.g, i.o, i.rn, case when w.size + i.n > {limit} then i.n else w.size + i.n end,
      case when w.size + i.n > {limit} then w.part + 1 else w.part end
    from walk w join items i on i.g = w.g and i.rn = w.rn + 1)
  select g, o, part from walk)"""


@query(f"with {LINES} select book_id, cast(idx as bigint) as idx, text from paras")
def paragraphs_indexed(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("book_id", F.col("idx").cast("long").alias("idx"), "text")


@query(f"""with {LINES}, sizes as (select book_id, sum(length(text)) as n from paras group by 1 having sum(length(text)) >= 200)
select book_id, cast(count(*) as bigint) as n_paragraphs from paras join sizes using (book_id) group by 1""")
def drop_tiny_segments(spark, sf_dir):
    lines = paragraphs.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return paragraphs.kept_segments(lines).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)}
select g as book_id, cast(o as bigint) as idx, cast(part as bigint) as part,
  cast(max(part) over (partition by g) as bigint) as part_count from packed""")
def pack_chunks(spark, sf_dir):
    dealt = paragraphs.packed(_paragraphs(spark, sf_dir), ["book_id"], "idx", F.length("text"), PACK_CHARS)
    return dealt.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "part", "part_count")])


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)},
around as (select book_id, idx, coalesce(list(idx) over (partition by book_id order by idx rows between 3 preceding and 1 preceding), []) as before from paras),
own as (select p.g, p.part, p.o, a.before from packed p join around a on a.book_id = p.g and a.idx = p.o)
select g as book_id, cast(row_number() over (partition by g order by part) - 1 as bigint) as chunk_index,
  cast(part as bigint) as part, cast(max(part) over (partition by g) as bigint) as part_count,
  array_to_string(arg_min(before, o), ',') as context, cast(min(o) as bigint) as first_idx, cast(count(*) as bigint) as n
from own group by g, part""")
def chunk_context3(spark, sf_dir):
    made = paragraphs.chunks(_paragraphs(spark, sf_dir), PACK_CHARS)
    return made.select(
        "book_id",
        *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "part", "part_count")],
        F.array_join(F.transform("context", lambda c: c["idx"].cast("string")), ",").alias("context"),
        F.get("paragraphs", F.lit(0))["idx"].cast("long").alias("first_idx"),
        F.size("paragraphs").cast("long").alias("n"),
    )


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)}
select g as book_id, cast(part as varchar) || '/' || cast(max(part) over (partition by g) as varchar) as section,
  cast(count(*) as bigint) as n, string_agg(cast(o as varchar), ',' order by o) as indices
from packed group by g, part""")
def chunk_payload_json(spark, sf_dir):
    told = paragraphs.labelling_payload(paragraphs.chunks(_paragraphs(spark, sf_dir), PACK_CHARS))
    field = lambda p: F.get_json_object("payload", p)
    return told.select(
        "book_id",
        field("$.section_within_chunk").alias("section"),
        field("$.number_of_indexed_paragraphs").cast("long").alias("n"),
        F.array_join(F.transform(gates.expected_indices(F.col("payload")), lambda i: i.cast("string")), ",").alias("indices"),
    )


@query(f"""with {SCENES}, sized as (select book_id, pos, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) as n from scenes),
{PACKED.format(group="book_id", order="pos", size="n", table="sized", limit=12000)}
select g as book_id, cast(o as bigint) as pos, cast(part as bigint) as batch,
  cast(row_number() over (partition by g, part order by o) - 1 as bigint) as index from packed""")
def batch_scenes(spark, sf_dir):
    made = enrich.batched(_scenes(spark, sf_dir).withColumnRenamed("text", "text_html"))
    return made.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "batch", "index")])


def _ranges(spark, sf_dir):
    """A labelled range for every paragraph of a document, some of them open at their ends, some noise."""
    return _ranges_of(_paragraphs(spark, sf_dir))


def _ranges_of(numbered):
    n = F.length("text")
    return numbered.select(
        "book_id",
        F.col("idx").alias("ord"),
        F.col("idx").cast("long").alias("start_paragraph_index"),
        (F.col("idx") + n % 3).cast("long").alias("end_paragraph_index"),
        (n % 2 == 0).alias("open_start_index"),
        (F.col("idx") % 3 != 0).alias("open_end_index"),
        F.concat(F.lit("t"), F.col("idx").cast("string")).alias("title"),
        F.when((F.col("idx") + n) % 11 == 0, "noise").otherwise("scene").alias("paragraph_type"),
        F.when(F.col("idx") % 4 == 0, "other").otherwise("prose").alias("content_form"),
    )


RANGES = f"""{LINES}, ranges as (select book_id, idx as ord, idx as s, idx + length(text) % 3 as e,
  length(text) % 2 = 0 as os, idx % 3 <> 0 as oe, 't' || idx as title, (idx + length(text)) % 11 = 0 as noise, idx % 4 = 0 as other from paras)"""
STITCHED = f"""{RANGES}, firsts as (select *, case when os and coalesce(lag(oe) over w, false) then 0 else 1 end as f from ranges
  where not noise window w as (partition by book_id order by ord)),
grouped as (select *, sum(f) over (partition by book_id order by ord) as g from firsts),
stitched as (select book_id, row_number() over (partition by book_id order by g) - 1 as scene,
  case when arg_min(os, ord) then greatest(arg_min(s, ord) - 1, 0) else arg_min(s, ord) end as s, arg_max(e, ord) as e,
  arg_min(title, ord) as title, case when arg_max(oe, ord) then 'broken_stitch' when count(*) > 1 then 'stitched'
    when arg_min(os, ord) then 'broken_stitch' else 'complete' end as stitch_status from grouped group by book_id, g)"""


@query(f"with {STITCHED} select book_id, cast(scene as bigint) as scene, cast(s as bigint) as start, cast(e as bigint) as \"end\", title, stitch_status from stitched")
def stitch_scenes(spark, sf_dir):
    made = scenes.stitched(scenes.without_noise(_ranges(spark, sf_dir)))
    return made.select("book_id", F.col("scene").cast("long").alias("scene"), "start", "end", "title", "stitch_status")


@query(f"""with {STITCHED},
wanted as (select book_id, scene, unnest(range(s, e + 1)) as idx from stitched),
texts as (select w.book_id, w.scene, '<p>' || string_agg(regexp_replace(p.text, '{WHITE_ENDS}', '', 'g'), '</p><p>' order by w.idx) || '</p>' as html
  from wanted w join paras p on p.book_id = w.book_id and p.idx = w.idx group by 1, 2),
whole as (select s.book_id, s.scene, coalesce(t.html, '<p></p>') as html from stitched s left join texts t on t.book_id = s.book_id and t.scene = s.scene)
select book_id, cast(scene as bigint) as scene, md5(html) as html_md5,
  cast(len(list_filter(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g'), ' '), lambda x: x <> '')) as bigint) as word_count from whole""")
def scene_text_range_join(spark, sf_dir):
    made = scenes.scene_text(scenes.stitched(scenes.without_noise(_ranges(spark, sf_dir))), _paragraphs(spark, sf_dir))
    return made.select("book_id", F.col("scene").cast("long").alias("scene"), F.md5("text_html").alias("html_md5"), "word_count")


# -- whole sources as books: groups that are larger than a task


def _by_source(spark, sf_dir):
    """The paragraphs of all documents of a source, numbered as one book."""
    docs = _t(spark, sf_dir, "documents")
    cut = paragraphs.lines(docs, "doc_id", "text").withColumn("doc_id", F.col("book_id").cast("long"))
    rows = cut.join(docs.select("doc_id", "source"), "doc_id").select("source", F.struct("doc_id", "para").alias("at"), "text")
    return spread.numbered(rows, "source", "at", "idx", range_rows=SPREAD_ROWS)


SPREAD_ROWS = 50_000
BY_SOURCE = f"""{LINES}, src as (select source as book_id, row_number() over (partition by source order by doc_id, para) - 1 as idx, l.text
  from lines l join documents d on cast(d.doc_id as varchar) = l.book_id where l.text <> '')"""


@query(f"with {BY_SOURCE} select book_id, cast(idx as bigint) as idx, md5(text) as text_md5 from src")
def source_paragraphs(spark, sf_dir):
    return _by_source(spark, sf_dir).select(F.col("source").alias("book_id"), "idx", F.md5("text").alias("text_md5"))


@query(f"""with {BY_SOURCE}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="src", limit=PACK_CHARS)}
select g as book_id, cast(o as bigint) as idx, cast(part as bigint) as part, cast(max(part) over (partition by g) as bigint) as part_count from packed""")
def source_parts(spark, sf_dir):
    rows = _by_source(spark, sf_dir).withColumnRenamed("source", "book_id")
    return spread.packed(rows, "book_id", "idx", F.length("text"), PACK_CHARS, SPREAD_ROWS)


SOURCE_SCENES = STITCHED.replace(LINES, BY_SOURCE).replace("from paras)", "from src)")


@query(f"""with {SOURCE_SCENES} select book_id || '-' || scene as scene_id, lag(book_id || '-' || scene) over w as prev_scene_id, lead(book_id || '-' || scene) over w as next_scene_id,
  cast(s as bigint) as start, cast(e as bigint) as "end", title, stitch_status from stitched window w as (partition by book_id order by scene)""")
def source_scenes(spark, sf_dir):
    labels = _ranges_of(_by_source(spark, sf_dir).withColumnRenamed("source", "book_id"))
    made = spread.linked(spread.stitched(scenes.without_noise(labels), SPREAD_ROWS))
    return made.select("scene_id", "prev_scene_id", "next_scene_id", "start", "end", "title", "stitch_status")


@query(f"with {SCENES} select book_id, pos, scene_id, prev_scene_id, next_scene_id from scenes")
def scene_ids_prev_next(spark, sf_dir):
    return _scenes(spark, sf_dir).select("book_id", "pos", "scene_id", "prev_scene_id", "next_scene_id")


@query(f"with {SCENES} select scene_id, prev_tone, next_tone from scenes")
def neighbor_tones(spark, sf_dir):
    return scenes.neighbor_tones(_scenes(spark, sf_dir)).select("scene_id", "prev_tone", "next_tone")


@query(f"with {SCENES} select scene_id, prev_tone, next_tone from scenes")
def neighbor_tones_window(spark, sf_dir):
    return _scenes(spark, sf_dir).select("scene_id", "prev_tone", "next_tone")


@query(f"with {SCENES} select scene_id, book_id, pos from scenes where dominant_tone = 'assistant' and prev_tone = 'user'")
def transition_find(spark, sf_dir):
    found = relational.find(_scenes(spark, sf_dir), dominant_tone="assistant", prev_tone="user")
    return found.select("scene_id", "book_id", "pos")


@query(f"with {SCENES} select scene_id, dominant_tone from scenes where dominant_tone in ('user', 'system')")
def facet_in_filter(spark, sf_dir):
    return relational.find(_scenes(spark, sf_dir), order=False, dominant_tone=["user", "system"]).select("scene_id", "dominant_tone")


@query(f"""with {SCENES}, told as (select book_id, cast(case when pos % 2 = 0 then null when pos % 3 = 0 then '' else dominant_tone end as varchar) as tone from scenes)
select book_id, cast(count(*) as bigint) as n, cast(0 as bigint) as n_met, cast(count(*) filter (tone = '') as bigint) as n_blank,
  cast(count(*) filter (tone in ('user', 'assistant')) as bigint) as n_listed from told group by 1""")
def facet_empty_in(spark, sf_dir):
    """Per book, the scenes and those that lists of tones let through: an empty one, one of nulls, one with a blank, one of tones and a null."""
    tone = F.when(F.col("pos") % 2 == 0, None).when(F.col("pos") % 3 == 0, "").otherwise(F.col("dominant_tone"))
    met = lambda values: F.count_if(relational.condition({"dominant_tone": values}))
    return _scenes(spark, sf_dir).withColumn("dominant_tone", tone).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n"), (met([]) + met([None]) + met(None)).alias("n_met"), met([None, ""]).alias("n_blank"), met(["user", None, "assistant"]).alias("n_listed")
    )


@query(f"with {SCENES} select scene_id, book_id, pos from scenes order by book_id, pos, scene_id limit 25")
def find_ordered_limit(spark, sf_dir):
    return relational.find(_scenes(spark, sf_dir), limit=25).select("scene_id", "book_id", "pos")


@query(f"with {SCENES} select scene_id, book_id, pos, dominant_tone from scenes where scene_id = '3-1'")
def get_scene(spark, sf_dir):
    return relational.get(_scenes(spark, sf_dir), "3-1").select("scene_id", "book_id", "pos", "dominant_tone")


@query(f"with {SCENES}, a as (select book_id, pos from scenes where scene_id = '3-1') select s.scene_id, s.pos from scenes s join a on s.book_id = a.book_id and s.pos between a.pos - 1 and a.pos + 2")
def neighbors_of_one(spark, sf_dir):
    return relational.neighbors(_scenes(spark, sf_dir), "3-1", 1, 2).select("scene_id", "pos")


@query(f"""with {SCENES} select s.scene_id, string_agg(o.scene_id, ',' order by o.pos) as around
from scenes s join scenes o on o.book_id = s.book_id and o.pos between s.pos - 1 and s.pos + 1 group by 1""")
def neighbors_of_all(spark, sf_dir):
    return relational.windows(_scenes(spark, sf_dir)).select("scene_id", F.array_join("around", ",").alias("around"))


# -- the same from the table laid out for lookups; the scenes of every twentieth book are asked for at once


def _laid_out(spark, sf_dir):
    rows = _scenes(spark, sf_dir)
    laid = layout.SceneTable(spark, tables.scratch(spark, "scenes"), rows.schema, rows_per_part=max(100, rows.count() // 64))
    laid.build(rows, buckets=16)
    return laid, rows.where(F.col("book_id").cast("long") % 20 == 0).select("scene_id")


@query(f"with {SCENES} select scene_id, book_id, pos, dominant_tone, text from scenes where cast(book_id as bigint) % 20 = 0")
def laid_out_get(spark, sf_dir):
    laid, ids = _laid_out(spark, sf_dir)
    return laid.get_each(ids).select("scene_id", "book_id", "pos", "dominant_tone", "text")


@query(f"""with {SCENES} select s.scene_id, string_agg(o.scene_id, ',' order by o.pos) as around
from scenes s join scenes o on o.book_id = s.book_id and o.pos between s.pos - 2 and s.pos + 1 where cast(s.book_id as bigint) % 20 = 0 group by 1""")
def laid_out_neighbors(spark, sf_dir):
    laid, ids = _laid_out(spark, sf_dir)
    return laid.neighbors_each(ids, 2, 1).select("scene_id", F.array_join("around", ",").alias("around"))


@query(f"with {SCENES} select scene_id, book_id, pos from scenes where dominant_tone = 'assistant' and prev_tone in ('user', 'system')")
def laid_out_find(spark, sf_dir):
    laid, _ = _laid_out(spark, sf_dir)
    return laid.find(order=False, dominant_tone="assistant", prev_tone=["user", "system"]).select("scene_id", "book_id", "pos")


@query(f"with {SCENES} select cast(count(*) as bigint) as n from scenes where dominant_tone = 'user'")
def count_filtered(spark, sf_dir):
    return relational.count(_scenes(spark, sf_dir), dominant_tone="user")


@query(f"with {SCENES} select dominant_tone, cast(count(*) as bigint) as n from scenes group by 1")
def tally_tone(spark, sf_dir):
    return relational.tally(_scenes(spark, sf_dir), "dominant_tone")


@query("select cast(l.quality as varchar) as dominant_tone, cast(count(*) as bigint) as n from documents d left join labels l using (doc_id) group by 1")
def tally_with_null(spark, sf_dir):
    joined = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.tally(joined.select(F.col("quality").cast("string").alias("dominant_tone")), "dominant_tone")


@query(f"""with {RANGES}, covered as (select book_id, unnest(range(s, e + 1)) as idx from ranges),
counts as (select book_id, idx, count(*) as times from covered group by 1, 2),
wanted as (select book_id, idx from paras),
both_ as (select coalesce(w.book_id, c.book_id) as book_id, coalesce(w.idx, c.idx) as idx, w.idx is null as extra, c.idx is null as missing, c.times
  from wanted w full join counts c on c.book_id = w.book_id and c.idx = w.idx)
select book_id, coalesce(string_agg(cast(idx as varchar), ',' order by idx) filter (missing), '') as missing,
  coalesce(string_agg(cast(idx as varchar), ',' order by idx) filter (extra), '') as extra,
  coalesce(string_agg(cast(idx as varchar), ',' order by idx) filter (times > 1), '') as repeated,
  not (bool_or(missing) or bool_or(extra) or bool_or(coalesce(times > 1, false))) as valid from both_ group by 1""")
def coverage_check(spark, sf_dir):
    ranges = _ranges(spark, sf_dir).select("book_id", F.col("start_paragraph_index").alias("start"), F.col("end_paragraph_index").alias("end"))
    found = gates.coverage(_paragraphs(spark, sf_dir).select("book_id", "idx"), ranges, "book_id")
    return found.select("book_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "repeated")], "valid")


@query(f"""with {RANGES}, sums as (select book_id, sum(case when noise then e - s + 1 else 0 end) as noise,
  sum(case when noise then 0 else e - s + 1 end) as kept, sum(case when not noise and other then e - s + 1 else 0 end) as other from ranges group by 1)
select book_id, cast(noise as bigint) as noise, cast(kept as bigint) as kept, cast(other as bigint) as other,
  round(case when kept > 0 then cast(other as double) / kept else 0 end, 6) as other_share, (case when kept > 0 then cast(other as double) / kept else 0 end) <= 0.7 as passes from sums""")
def noise_other_gate(spark, sf_dir):
    return gates.share_of_other(_ranges(spark, sf_dir)).withColumn("other_share", F.round("other_share", 6))


@query("""with b as (select doc_id, lang, lower(concat_ws(' ', source, text)) as subject from documents)
select doc_id, case when coalesce(lang, '') <> 'en' then 'rights' when regexp_matches(subject, 'poems|poetry|plays|drama') then 'subjects' end as reason,
  case when coalesce(lang, '') <> 'en' then coalesce('in ' || lang, 'none stated') when regexp_matches(subject, 'poems|poetry|plays|drama') then md5(subject) end as detail from b""")
def book_gate(spark, sf_dir):
    """Documents as books: English ones have the rights, and the whole text is their subject."""
    docs = _t(spark, sf_dir, "documents")
    rights = F.when(F.col("lang") == "en", F.lit("Public domain in the USA.")).otherwise(F.concat(F.lit("in "), F.col("lang")))
    subjects = F.array(F.lower(F.concat_ws(" ", "source", "text")))
    told = docs.select("doc_id", rights.alias("rights"), subjects.alias("subjects"))
    told = told.withColumn("reason", gates.book_gate(F.col("rights"), F.col("subjects")))
    detail = gates.gate_detail(F.col("reason"), F.col("rights"), F.col("subjects"))
    return told.select("doc_id", "reason", F.when(F.col("reason") == "subjects", F.md5(detail)).otherwise(detail).alias("detail"))


@query("""select page_id, case when regexp_matches(html, '(?i)name="dc\\.rights"\\s+content="([^"]*)"') then trim(regexp_extract(html, '(?i)name="dc\\.rights"\\s+content="([^"]*)"', 1)) end as rights from pages""")
def rights_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", archive.rights(F.col("html")).alias("rights"))


@query("""select page_id, cast(len(list_filter(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), lambda x: x <> '')) as bigint) as words from pages""")
def plain_text_wordcount(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.word_count(F.col("html")).alias("words"))


@query()
def page_paragraphs(spark, sf_dir):
    return archive.paragraphs(_t(spark, sf_dir, "pages"), "page_id", "html")


@query("""select c_custkey, trim(split_part(c_name || ', Ann, 1802-1870 [author]', ',', 2)) || ' ' || c_name as name from customer""")
def name_flip(spark, sf_dir):
    entry = F.concat("c_name", F.lit(", Ann, 1802-1870 [author]"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.flipped_name(entry).alias("name"))


@query("select o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') as issued from orders")
def date_text(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.display_date(day).alias("issued"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(list_filter([trim(x) for x in string_split(p_type || '; ' || p_brand || ';; ' || p_type, ';')], lambda x: x <> ''))), '|') as subjects from part""")
def subjects_set(spark, sf_dir):
    line = F.concat("p_type", F.lit("; "), "p_brand", F.lit(";; "), "p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.subjects(line), "|").alias("subjects"))


#: DuckDB's upper() gives one letter for one; these have several (``ß``: ``SS``), or were given a capital later than its tables.
CAPITALS = {chr(c): chr(c).upper() for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1}
CAPITALS |= {chr(a): chr(b) for a, b in ((0x19B, 0xA7DC), (0x264, 0xA7CB), (0x1C8A, 0x1C89), (0xA7CD, 0xA7CC), (0xA7DB, 0xA7DA), *((c, c - 32) for c in range(0x10D70, 0x10D86)))}
UPPER_FIRST = "coalesce(map([{0}], [{1}])[substr(t, 1, 1)], upper(substr(t, 1, 1)))".format(*(", ".join(f"'{c}'" for c in x) for x in (CAPITALS, CAPITALS.values())))


@query(f"""with one as (select doc_id, trim(regexp_replace(text, '{WHITE}+', ' ', 'g')) as t from documents)
select doc_id, md5(case when t <> '' then regexp_replace({UPPER_FIRST} || substr(t, 2), '[ .]+$', '') || '.' end) as summary_md5 from one""")
def summary_normalise(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.summary(F.col("text"))).alias("summary_md5"))


@query(f"""select doc_id, md5(array_to_string(list_filter([lower(regexp_replace(x, '{WHITE_ENDS}', '', 'g')) for x in string_split(text, '.')], lambda x: x <> ''), '|')) as terms_md5 from documents""")
def descriptor_normalise(spark, sf_dir):
    """The sentences of every text as its descriptors."""
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(F.array_join(text.descriptors(F.split("text", "[.]")), "|")).alias("terms_md5"))


@query(f"""with {SCENES}, h as (select scene_id, sha1(unhex('{NAMESPACE.hex}') || encode(scene_id)) as d from scenes)
select scene_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(d, 17, 1)), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as point_id from h""")
def uuid5_ids(spark, sf_dir):
    return _scenes(spark, sf_dir).select("scene_id", text.uuid5(F.col("scene_id"), NAMESPACE).alias("point_id"))


@query("select user_id, event_type, arg_max(event_id, struct_pack(ts := ts, e := event_id)) as event_id, arg_max(value, struct_pack(ts := ts, e := event_id)) as value from events group by 1, 2")
def upsert_latest(spark, sf_dir):
    newest = upsert.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return newest.select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_type, arg_max(event_id, struct_pack(ts := ts, e := event_id)) as event_id from events group by 1, 2")
def stream_upsert(spark, sf_dir):
    """The same from a stream of four files, a micro-batch each, whose times overlap: rows that come late change nothing."""
    path, arriving = tables.scratch(spark, "stream"), tables.scratch(spark, "arriving")
    events, keys = _t(spark, sf_dir, "events"), ["user_id", "event_type"]
    events.repartition(4, F.xxhash64("event_id")).write.parquet(arriving)
    stream = ingest.start(spark, arriving, events.schema, path, f"{path}-marks", keys, ["ts", "event_id"], files_per_batch=1)
    stream.awaitTermination()
    return ingest.table(spark, path, events.schema, keys, ["ts", "event_id"]).table().select(*keys, "event_id")


@query("""select user_id, event_type, arg_max(event_id, event_id) as event_id from events group by 1, 2""")
def upsert_merge(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    keys = ["user_id", "event_type"]
    old = upsert.latest(events.where("event_id % 2 = 0"), keys, ["event_id"])
    new = events.join(old.select(*keys, F.col("event_id").alias("had")), keys, "left").where("event_id % 2 = 1 and (had is null or event_id > had)")
    return upsert.merged(old, new.drop("had"), keys, ["event_id"])


@query("""select cast(count(*) as bigint) as n_rows, cast(count(*) filter (had is null) as bigint) as n_new, cast(count(had) as bigint) as n_replaced
from (select distinct user_id, event_type from events where event_id % 2 = 1) left join
  (select distinct user_id, event_type, 1 as had from events where event_id % 2 = 0) using (user_id, event_type)""")
def upsert_effects(spark, sf_dir):
    """How many rows an upsert of the odd events into the even ones adds and replaces."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return upsert.effects(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)}
select g as book_id, cast(count(distinct part) as bigint) as n_chunks, cast(count(*) as bigint) as n_paragraphs, md5(string_agg(text, '|' order by o)) as texts_md5
from packed join paras on book_id = g and idx = o group by 1""")
def chunk_roundtrip(spark, sf_dir):
    """Chunks written as JSON for people, and read back."""
    told = paragraphs.inspection_payload(paragraphs.chunks(_paragraphs(spark, sf_dir), PACK_CHARS))
    parts = paragraphs.from_inspection(told).select("book_id", "chunk_index", F.explode("paragraphs").alias("p"))
    listed = F.array_sort(F.collect_list("p"))
    return parts.groupBy("book_id").agg(
        F.count_distinct("chunk_index").alias("n_chunks"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.md5(F.array_join(F.transform(listed, lambda p: p["text"]), "|")).alias("texts_md5"),
    )


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_todo(spark, sf_dir):
    return gates.pending(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query(f"""with {SCENES} select scene_id, book_id, cast(pos as bigint) as pos, cast(null as varchar) as dominant_tone, cast(null as varchar) as prev_tone, cast(null as varchar) as next_tone from scenes""")
def facet_reset(spark, sf_dir):
    made = enrich.reset(_scenes(spark, sf_dir), "tone", "prev_tone", "next_tone")
    return made.select("scene_id", "book_id", "pos", "dominant_tone", "prev_tone", "next_tone")


@query(f"""with {SCENES} select scene_id, cast(split_part(scene_id, '-', 2) as int) as pos from scenes""")
def position_of_id(spark, sf_dir):
    return _scenes(spark, sf_dir).select("scene_id", text.position(F.col("scene_id")).alias("pos"))


def _records(spark, sf_dir):
    """Scenes with all record fields that the relational table takes; the facets are null."""
    rows = _scenes(spark, sf_dir).drop("dominant_tone", "prev_tone", "next_tone")
    none = ["dominant_tone", "prev_tone", "next_tone", "author", "intensity", "arc", "chapter_title", "summary", "enrich_model"]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in none})
    return rows.withColumns(
        {
            "language": F.lit("en"),
            "stitch_status": F.lit("complete"),
            "scene_title": F.concat(F.lit("turn "), F.col("pos").cast("string")),
            "word_count": text.word_count(F.col("text")).cast("int"),
            "start_paragraph_index": F.col("pos").cast("int"),
            "end_paragraph_index": F.col("pos").cast("int"),
            "descriptors": F.lit(None).cast("array<string>"),
            "enriched": F.lit(False),
            "schema_version": F.lit(1),
        }
    )


@query(f"""with {SCENES} select scene_id, book_id, cast(pos as int) as pos, prev_scene_id, next_scene_id, 'turn ' || pos as scene_title,
  cast(len(list_filter(string_split(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), lambda x: x <> '')) as int) as word_count,
  '[]' as descriptors, 0 as enriched, '1' as schema_version from scenes""")
def mirror_rows(spark, sf_dir):
    columns = ["scene_id", "book_id", "pos", "prev_scene_id", "next_scene_id", "scene_title", "word_count", "descriptors", "enriched", "schema_version"]
    return relational.mirror(_records(spark, sf_dir)).select(*columns)


@query(f"""with {SCENES} select case when pos % 3 = 0 then scene_id || 'x' else scene_id end as scene_id, book_id, pos,
  case when pos % 3 = 0 then 3 when pos % 2 = 0 then 2 else 1 end as version from scenes""")
def upsert_two_keys(spark, sf_dir):
    """All scenes, then every second one anew, then every third place taken over by another id."""
    rows = _scenes(spark, sf_dir).select("scene_id", "book_id", "pos")
    second = rows.where("pos % 2 = 0").withColumn("version", F.lit(2))
    third = rows.where("pos % 3 = 0").withColumn("scene_id", F.concat("scene_id", F.lit("x"))).withColumn("version", F.lit(3))
    return upsert.replaced(rows.withColumn("version", F.lit(1)), second.union(third), ["version"])


@query(f"""with {SCENES}, f as (select *, case when pos % 2 = 0 then dominant_tone end as tone from scenes)
select scene_id, tone as dominant_tone, lag(tone) over w as prev_tone, lead(tone) over w as next_tone, pos % 2 = 0 as enriched,
  case when pos % 2 = 0 then 'stub' end as enrich_model from f window w as (partition by book_id order by pos)""")
def enrichment_applied(spark, sf_dir):
    facets = _scenes(spark, sf_dir).where("pos % 2 = 0").select(
        "scene_id",
        "dominant_tone",
        F.lit("low").alias("intensity"),
        F.lit("steady").alias("arc"),
        F.array(*[F.lit(x) for x in "abcde"]).alias("descriptors"),
        F.lit("One.").alias("summary"),
    )
    made = enrich.applied(_records(spark, sf_dir), facets, "stub")
    return made.select("scene_id", "dominant_tone", "prev_tone", "next_tone", "enriched", "enrich_model")


# -- the catalog: parts stand for books, several rows to a book; models: stubs that answer wrongly now and then


def _catalog_rows(spark, sf_dir):
    parts = _t(spark, sf_dir, "part")
    return parts.select(
        (F.col("p_partkey") % 500).cast("string").alias("Text#"),
        F.col("p_name").alias("Title"),
        F.concat("p_brand", F.lit(", Ann, 1802-1870; "), "p_type", F.lit(", Bo [Translator]")).alias("Authors"),
        F.concat("p_type", F.lit("; "), "p_brand", F.lit(";; "), "p_type").alias("Subjects"),
        F.lit("en").alias("Language"),
        F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("Issued"),
        "p_partkey",
    )


def _catalog(spark, sf_dir):
    return catalog.last_wins(_catalog_rows(spark, sf_dir), "p_partkey")


def _flat(books):
    return books.withColumn("Subjects", F.array_join("Subjects", "|"))


CATALOG = """last as (select p_partkey % 500 as k, max(p_partkey) as p_partkey from part group by 1),
books as (select cast(k as varchar) as "ID", 'https://www.gutenberg.org/ebooks/' || k as "Link", 'Ann ' || p_brand as "Author", 'Bo ' || p_type as "Translator",
  p_name as "Title", array_to_string(list_sort(list_distinct([p_type, p_brand])), '|') as "Subjects",
  strftime(date '2001-01-01' + cast(p_size as int), '%B ') || day(date '2001-01-01' + cast(p_size as int)) || strftime(date '2001-01-01' + cast(p_size as int), ', %Y') as "Date",
  'en' as "Language" from last join part using (p_partkey))"""


@query(f"with {CATALOG} select * from books")
def catalog_metadata(spark, sf_dir):
    return _flat(catalog.metadata(_catalog(spark, sf_dir)))


@query(f"with {CATALOG} select * from books where cast(\"ID\" as int) % 3 = 0")
def catalog_by_code(spark, sf_dir):
    """The books that a list of codes asks for; the codes repeat."""
    codes = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("code")).where("code % 3 = 0")
    return _flat(catalog.metadata(_catalog(spark, sf_dir), codes.select(F.col("code").cast("string").alias("code"))))


@query("select doc_id, cast(coalesce(length(text), 0) as bigint) as n from documents")
def read_through(spark, sf_dir):
    """Every document through a cache that half of them are in already."""
    docs, path = _t(spark, sf_dir, "documents").select("doc_id", "text"), tables.scratch(spark, "cache")
    make = lambda rows: rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    tables.read_through(docs.where("doc_id % 2 = 0"), path, "doc_id long, n long", "doc_id", make)
    return tables.read_through(docs, path, "doc_id long, n long", "doc_id", make)


@query(f"""with {SCENES}, sized as (select book_id, pos, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g')) as t from scenes),
{PACKED.format(group="book_id", order="pos", size="length(t)", table="sized", limit=12000)}
select g as book_id, cast(part as bigint) as batch, cast(count(*) as bigint) as n, md5(string_agg(t, '|' order by o)) as texts_md5, 'turn ' || min(o) as first_title
from packed join sized on book_id = g and pos = o group by 1, 2""")
def enrich_payload(spark, sf_dir):
    batches = enrich.batched(_records(spark, sf_dir).withColumnRenamed("text", "text_html"))
    told = enrich.payloads(batches)
    read = F.from_json("payload", "scenes array<struct<index int, scene_title string, chapter_title string, text string>>")["scenes"]
    told = told.withColumn("s", read)
    texts = F.array_join(F.transform("s", lambda x: x["text"]), "|")
    return told.select("book_id", F.col("batch").cast("long").alias("batch"), F.size("s").cast("long").alias("n"), F.md5(texts).alias("texts_md5"), F.get("s", F.lit(0))["scene_title"].alias("first_title"))


@query(f"""with {STITCHED}, wanted as (select book_id, scene, unnest(range(s, e + 1)) as idx from stitched),
texts as (select w.book_id, w.scene, string_agg(regexp_replace(p.text, '{WHITE_ENDS}', '', 'g'), ' ' order by w.idx) as t
  from wanted w join paras p on p.book_id = w.book_id and p.idx = w.idx group by 1, 2)
select s.book_id || '-' || scene as scene_id, lag(s.book_id || '-' || scene) over w as prev_scene_id, lead(s.book_id || '-' || scene) over w as next_scene_id,
  title as scene_title, case when exists (select 1 from paras p where p.book_id = s.book_id and p.idx = s.s) then 'chapter ' || s.s // 5 end as chapter_title,
  stitch_status, d.source as author, d.lang as language, false as enriched,
  cast(len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(t, ''), '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g'), ' '), lambda x: x <> '')) as int) as word_count
from stitched s left join texts using (book_id, scene) left join documents d on cast(d.doc_id as varchar) = s.book_id window w as (partition by s.book_id order by scene)""")
def scene_records(spark, sf_dir):
    """Whole scene records, with the chapter of the paragraph they start at and their book's metadata."""
    numbered = _paragraphs(spark, sf_dir).withColumn("chapter_title", F.concat(F.lit("chapter "), F.floor(F.col("idx") / 5).cast("string")))
    books = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ID"), F.col("source").alias("Author"), F.col("lang").alias("Language"))
    made = scenes.records(_ranges(spark, sf_dir), numbered, books)
    return made.select("scene_id", "prev_scene_id", "next_scene_id", "scene_title", "chapter_title", "stitch_status", "author", "language", "enriched", "word_count")


@query(f"""with {SCENES} select scene_id, cast(pos as int) as pos, cast(case when pos % 2 = 0 then 5 else 0 end as bigint) as n_descriptors,
  case when pos % 2 = 0 then 'e' end as last_descriptor from scenes""")
def row_roundtrip(spark, sf_dir):
    """Records to rows of the relational table and their descriptors back from JSON."""
    five = F.when(F.col("pos") % 2 == 0, F.array(*[F.lit(x) for x in "abcde"]))
    rows = relational.reinflated(relational.mirror(_records(spark, sf_dir).withColumn("descriptors", five)))
    return rows.select("scene_id", "pos", F.size("descriptors").cast("long").alias("n_descriptors"), F.get("descriptors", F.lit(4)).alias("last_descriptor"))


@query(f"""with {SCENES} select scene_id, cast(null as varchar) as summary, false as enriched, cast(null as varchar) as enrich_model,
  case when pos % 2 = 0 then 'steady' end as arc from scenes""")
def gate_reset(spark, sf_dir):
    """Scenes that are to be enriched anew: the summary and its marks go, the other facets stay."""
    even = F.col("pos") % 2 == 0
    rows = _records(spark, sf_dir).withColumns({"summary": F.when(even, "One."), "enriched": even, "enrich_model": F.when(even, "stub"), "arc": F.when(even, "steady")})
    return enrich.reset(rows, "enriched").select("scene_id", "summary", "enriched", "enrich_model", "arc")


def _careless_labeller(payload: str, notes: list[str], warmth: float) -> str:
    """One range over all paragraphs; it leaves the last out at first, and always where their number is divisible by 3."""
    at = [p["index"] for p in json.loads(payload)["indexed_paragraphs"]]
    short = len(at) % 3 == 0 or not notes
    return json.dumps({"scenes_data": [{"start_paragraph_index": at[0], "end_paragraph_index": at[-1] - short, "title": "all"}]})


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)}
select g as book_id, cast(row_number() over (partition by g order by part) - 1 as bigint) as chunk_index, count(*) % 3 = 0 as failed,
  cast(case when count(*) % 3 <> 0 then min(o) end as bigint) as start, cast(case when count(*) % 3 <> 0 then max(o) end as bigint) as "end" from packed group by g, part""")
def labels_checked(spark, sf_dir):
    """A labeller's answers, asked for again while a paragraph is left out; chunks that never get a valid one are named."""
    told = flow.told(paragraphs.chunks(_paragraphs(spark, sf_dir), PACK_CHARS), _careless_labeller, attempts=2)
    one = F.get("answer.scenes_data", F.lit(0))
    return told.select(
        "book_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("failure").isNotNull().alias("failed"),
        *[one[f"{x}_paragraph_index"].cast("long").alias(x) for x in ("start", "end")],
    )


def _careless_enricher(payload: str, notes: list[str], warmth: float) -> str:
    """Facets for each scene, with a tone of no vocabulary for every third one; the last scene of a batch gets none where there are several."""
    told = [s["index"] for s in json.loads(payload)["scenes"]]
    facets = {"intensity": "low", "arc": "turn", "descriptors": list("abcde"), "summary": "s"}
    named = told[:-1] if len(told) > 1 else told
    return json.dumps({"items": [{"index": i, "dominant_tone": "joy" if i % 3 else "odd", **facets} for i in named]})


@query(f"""with {SCENES}, sized as (select book_id, pos, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g'))) as n from scenes),
{PACKED.format(group="book_id", order="pos", size="n", table="sized", limit=12000)},
placed as (select g, o, row_number() over (partition by g, part order by o) - 1 as i, count(*) over (partition by g, part) as k from packed)
select g || '-' || o as scene_id, case when k > 1 and i = k - 1 then 'no item' when i % 3 = 0 then 'facets out of vocabulary' end as failure,
  case when (k = 1 or i < k - 1) and i % 3 <> 0 then 'joy' end as dominant_tone from placed""")
def facets_checked(spark, sf_dir):
    """An enricher's answers, taken as they are: scenes without an item, or with an invalid one, are named."""
    batches = enrich.batched(_records(spark, sf_dir).withColumnRenamed("text", "text_html"))
    return enrich.ask(batches, _careless_enricher, None).select("scene_id", "failure", "dominant_tone")


# -- what is kept between runs: files of scenes, marks of books, vectors of texts, checkpoints


@query(f"""with {SCENES} select scene_id, book_id, cast(pos as bigint) as pos, dominant_tone, prev_tone, md5(text) as text_md5, false as broken from scenes""")
def scene_files(spark, sf_dir):
    """All scenes written as one JSON file set a book, and read back from there with the book of the folder."""
    path = tables.scratch(spark, "scene-files")
    tables.write_json(_scenes(spark, sf_dir).select("scene_id", "book_id", "pos", "dominant_tone", "prev_tone", "text"), path)
    rows = tables.read_json(spark, path, "scene_id string, book_id string, pos long, dominant_tone string, prev_tone string, text string", lines=True)
    return rows.select("scene_id", "book_id", "pos", "dominant_tone", "prev_tone", F.md5("text").alias("text_md5"), F.col("_corrupt_record").isNotNull().alias("broken"))


@query("""with told as (select distinct conv_id from conversations),
marks as (select cast(conv_id as varchar) as book_id, case when conv_id % 3 = 0 then 'completed' else 'open' end as status from told where conv_id % 2 = 0 or conv_id % 3 = 0)
select book_id, status from marks where cast(book_id as bigint) % 5 <> 0""")
def status_marks(spark, sf_dir):
    """Every second book is marked open, then every third completed; the marks of every fifth are taken away."""
    books = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id")).distinct()
    every = lambda n: books.where(F.col("book_id").cast("long") % n == 0)
    opened = tables.marked(spark.createDataFrame([], "book_id string, status string"), every(2), "open")
    return tables.unmarked(tables.marked(opened, every(3)), every(5))


@query(f"""with {SCENES}, told as (select scene_id, book_id, pos % 2 = 0 as enriched, case when pos % 3 = 0 then '' when pos % 3 = 1 then 'One.' end as summary from scenes)
select scene_id, not (enriched and coalesce(summary, '') <> '') as to_enrich, coalesce(summary, '') <> '' as to_index from told
where cast(book_id as bigint) % 4 <> 0""")
def enrichment_gates(spark, sf_dir):
    """Which scenes are still to be enriched, which may be indexed; the books of every fourth number are completed and passed over."""
    rows = _scenes(spark, sf_dir).select("scene_id", "book_id", (F.col("pos") % 2 == 0).alias("enriched"), F.when(F.col("pos") % 3 == 0, "").when(F.col("pos") % 3 == 1, "One.").alias("summary"))
    done = rows.where(F.col("book_id").cast("long") % 4 == 0).select("book_id").distinct()
    rows = gates.pending(rows, done, "book_id")
    missing = enrich.todo(rows).select("scene_id", F.lit(True).alias("to_enrich"))
    ready = gates.indexable(F.col("summary")).alias("to_index")
    return rows.select("scene_id", ready).join(missing, "scene_id", "left").select("scene_id", F.coalesce("to_enrich", F.lit(False)).alias("to_enrich"), "to_index")


def _counting_embedder(texts: list[str]) -> list[list[float]]:
    """Length, blanks and vowels of each text."""
    return [[float(len(t)), float(t.count(" ")), float(sum(t.count(c) for c in "aeiou"))] for t in texts]


@query(f"""with {SCENES} select scene_id, round(cast(length(text) as double), 3) as n, cast(length(text) - length(replace(text, ' ', '')) as double) as blanks,
  cast(length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) as double) as vowels from scenes""")
def vectors_remembered(spark, sf_dir):
    """Vectors of all scenes' texts from a memory that has those of every second scene already."""
    rows, memory = _scenes(spark, sf_dir).select("scene_id", "pos", "text"), tables.remembered(tables.scratch(spark, "vectors"), "counts")
    memory(rows.where("pos % 2 = 0"), "text", "v", _counting_embedder).write.format("noop").mode("overwrite").save()
    made = memory(rows, "text", "v", _counting_embedder)
    return made.select("scene_id", *[F.get("v", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("n", "blanks", "vowels"))])


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)},
chunks as (select g as book_id, cast(row_number() over (partition by g order by part) - 1 as bigint) as chunk_index, count(*) as n from packed group by g, part)
select book_id, chunk_index, n % 3 = 0 as failed from chunks where cast(book_id as bigint) % 2 = 1""")
def answers_resumed(spark, sf_dir):
    """A labeller's answers by way of a checkpoint: first those to every third book, then to all; the even books' are cleared."""
    payloads = paragraphs.labelling_payload(paragraphs.chunks(_paragraphs(spark, sf_dir), PACK_CHARS)).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    store, keys = tables.Store(tables.scratch(spark, "answers"), every=500), ["book_id", "chunk_index", "payload"]
    make = lambda rows: hooks.answered(rows, _careless_labeller, flow.LABELS, gates.uncovered, attempts=2)
    book = F.col("book_id").cast("long")
    store.resumed(payloads.where(book % 3 == 0), "told", keys, make)
    made = store.resumed(payloads, "told", keys, make)
    told = store(made.select("book_id", "chunk_index", F.col("failure").isNotNull().alias("failed")), "answers")
    store.clear("told", told.where(book % 2 == 0))
    left = store.kept(spark, "told", made.schema).select("book_id", "chunk_index").distinct()
    return told.join(left, ["book_id", "chunk_index"], "left_semi")


@query(f"with {CATALOG} select * from books")
def catalog_csv(spark, sf_dir):
    """The catalog as CSV files with quotes, commas and line ends in their fields, the rows of a book in several of them."""
    path, rows = tables.scratch(spark, "catalog"), _catalog_rows(spark, sf_dir)
    quoted = rows.withColumn("Title", F.concat(F.lit('"'), "Title", F.lit('",\n,"')))
    quoted.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select(*catalog.COLUMNS).write.csv(path, header=True, quote='"', escape='"')
    made = _flat(catalog.metadata(catalog.read(spark, path)))
    return made.withColumn("Title", F.regexp_extract("Title", '^"(.*)",\n,"$', 1))


#: An archive's file names, pages and lines: each third document has chapters, each third headings, each third neither.
ARCHIVED = """told as (select cast(doc_id as varchar) as book_id, doc_id, text, source from documents where doc_id % 7 <> 0),
cut as (select doc_id, book_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as para from told),
clean as (select doc_id, book_id, para, case when doc_id % 3 = 2 then 0 else para // 5 end as unit,
  trim(regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '{white}+', ' ', 'g')) as t from cut)"""


def _archives(spark, sf_dir):
    """Documents as zipped pages, a line a paragraph, every third one in Latin-1 as far as its letters allow; some files have other names."""

    @F.pandas_udf("binary")
    def zipped(pages: pd.Series, latin: pd.Series) -> pd.Series:
        return pd.Series([_zip_of(page, wanted) for page, wanted in zip(pages, latin)])

    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.col("doc_id") % 3
    open_unit = lambda i: F.when((kind == 2) | (i % 5 != 0), "").otherwise(
        F.concat(F.when(kind == 0, F.when(i > 0, "</div>").otherwise("")).otherwise(""), F.when(kind == 0, '<div class="chapter">').otherwise(""), F.lit("<h2>Part "), (i / 5).cast("int").cast("string"), F.lit("</h2>"))
    )
    lines = F.transform(F.split(escape(F.col("text")), "\n"), lambda t, i: F.concat(open_unit(i), F.lit("<p class='x'>"), t, F.lit("</p>")))
    body = F.concat(F.array_join(lines, "\n"), F.when(kind == 0, "</div>").otherwise(""))
    mark = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit('<meta name="dc.rights" content=" '), F.coalesce("source", F.lit("")), F.lit(' ">'))).otherwise("")
    page = F.concat(mark, F.lit("<body><section id='pg-header'><p>cut</p></section><!-- no -->"), F.coalesce(body, F.lit("")), F.lit("</body></html>"))
    name = F.concat(F.lit("/books/pg"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "-x.zip").otherwise("-h.zip"))
    files = _t(spark, sf_dir, "documents").select(name.alias("path"), zipped(page, F.col("doc_id") % 3 == 1).alias("content"))
    return archive.named(files)


def _zip_of(page: str, latin: bool) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cover.txt", "no page")
        try:
            z.writestr("book.html", ("<html><meta charset='ISO-8859-1'>" + page).encode("latin-1" if latin else "ascii"))
        except UnicodeEncodeError:
            z.writestr("book.html", "<html><meta charset='utf-8'>" + page)
    return held.getvalue()


@query(f"""with {ARCHIVED.format(white=WHITE)}, kept as (select *, dense_rank() over (partition by doc_id order by unit) - 1 as segment from clean where t <> '')
select book_id, cast(segment as int) as segment, case when doc_id % 3 < 2 then 'Part ' || unit end as heading,
  cast(row_number() over (partition by doc_id, unit order by para) - 1 as int) as para, md5(t) as text_md5 from kept""")
def archive_paragraphs(spark, sf_dir):
    """The paragraphs of all archives whose names have the form of a book's, by chapters, headings or none."""
    found = archive.paragraphs(archive.pages(_archives(spark, sf_dir)))
    return found.select("book_id", "segment", "heading", "para", F.md5("text").alias("text_md5"))


@query("select cast(doc_id as varchar) as book_id, case when doc_id % 5 > 0 then trim(coalesce(source, '')) end as rights from documents where doc_id % 7 <> 0")
def archive_rights(spark, sf_dir):
    return archive.archive_rights(_archives(spark, sf_dir))


@query(f"""with {LINES}, {PACKED.format(group="book_id", order="idx", size="length(text)", table="paras", limit=PACK_CHARS)},
texts as (select g as book_id, cast(count(distinct part) as bigint) as n_chunks, md5(string_agg(text, '|' order by o)) as texts_md5 from packed join paras on book_id = g and idx = o group by 1)
select cast(d.doc_id as varchar) as "ID", 'https://www.gutenberg.org/ebooks/' || d.doc_id as "Link", coalesce(lang, '') as "Title",
  case when source <> '' then source end as "Author", cast(null as varchar) as "Translator", array_to_string(list_sort(list_distinct(['é', 'book'])), '|') as "Subjects",
  cast(null as varchar) as "Date", '' as "Language", coalesce(n_chunks, 0) as n_chunks, texts_md5
from documents d left join texts on book_id = cast(d.doc_id as varchar)""")
def book_roundtrip(spark, sf_dir):
    """Every document as a book by way of a shelf of JSON lines: first every third one, then all, of which only the rest is made."""
    docs, path = _t(spark, sf_dir, "documents"), tables.scratch(spark, "shelf")
    key = F.col("doc_id").cast("string")

    def make(ids):
        own = docs.withColumn("book_id", key).join(ids, "book_id", "left_semi")
        rows = own.select(
            key.alias("Text#"), F.col("lang").alias("Title"), F.col("source").alias("Authors"), F.lit("é; book;").alias("Subjects"),
            F.lit(None).cast("string").alias("Language"), F.lit("").alias("Issued"), "doc_id",
        )
        parts = paragraphs.chunks(paragraphs.numbered(paragraphs.lines(own, "doc_id", "text")), PACK_CHARS)
        return catalog.metadata(catalog.last_wins(rows, "doc_id")), parts

    ids = docs.select(key.alias("book_id"))
    books.recalled(ids.where(F.col("book_id").cast("long") % 3 == 0), path, make)
    metadata, chunks = books.recalled(ids, path, make)
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", F.array_join(F.transform("paragraphs", lambda p: p["text"]), "|").alias("t"))))
    texts = chunks.groupBy(F.col("book_id").alias("ID")).agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(F.array_join(F.transform(listed, lambda c: c["t"]), "|")).alias("texts_md5"))
    return _flat(metadata).join(texts, "ID", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


@query(f"""with {SCENES} select scene_id, case when conv % 2 = 1 then dominant_tone end as dominant_tone, case when conv % 2 = 1 then 'One.' end as summary,
  conv % 2 = 1 as enriched, case when conv % 2 = 1 then 'completed' end as status, (select count(*) from scenes where cast(book_id as bigint) % 2 = 0) as n_reset
from (select *, cast(book_id as bigint) as conv from scenes)""")
def books_reset(spark, sf_dir):
    """Tone and summary of the even books' scenes are cleared, and with them the marks of those books."""
    rows = _records(spark, sf_dir).drop("dominant_tone").join(_scenes(spark, sf_dir).select("scene_id", "dominant_tone"), "scene_id")
    rows = rows.withColumns({"summary": F.lit("One."), "enriched": F.lit(True), "enrich_model": F.lit("stub")})
    told = rows.select("book_id").distinct()
    status = tables.marked(spark.createDataFrame([], "book_id string, status string"), told)
    even = told.where(F.col("book_id").cast("long") % 2 == 0)
    made, marks, n = flow.reset_books(rows, status, tables.Store(tables.scratch(spark, "reset")), "tone", "enriched", books=even)
    return made.join(marks, "book_id", "left").select("scene_id", "dominant_tone", "summary", "enriched", "status", F.lit(n).cast("long").alias("n_reset"))


@query(f"""with {SCENES}, told as (select *, cast(book_id as bigint) as conv from scenes)
select scene_id, case when conv % 2 = 0 then 'new' else 'old' end as had, cast(case when conv % 2 = 0 then length(text) + 1 else length(text) end as double) as n
from told where not (conv % 2 = 0 and pos % 3 = 0)
union all select scene_id, 'kept', cast(length(text) as double) from told where conv % 2 = 0 and pos % 3 = 0""")
def index_refreshed(spark, sf_dir):
    """The even books' scenes come anew with longer summaries, every third without one: those keep their vector in the index."""
    old = _records(spark, sf_dir).withColumn("summary", F.col("text"))
    longer = F.when(F.col("pos") % 3 != 0, F.concat("text", F.lit(".")))
    new = old.where(F.col("book_id").cast("long") % 2 == 0).withColumn("summary", longer)
    rows, index = flow.refreshed(relational.mirror(old.limit(0)), None, old, _counting_embedder)
    rows, index = flow.refreshed(rows, index, new, _counting_embedder)
    had = F.when(F.col("book_id").cast("long") % 2 != 0, "old").when(F.col("summary").isNull(), "kept").otherwise("new")
    return index.select("scene_id", F.get("summary_vec", F.lit(0)).cast("double").alias("n")).join(rows.select("scene_id", had.alias("had")), "scene_id")


@query("""select cast(conv_id as varchar) as book_id, case when conv_id % 3 = 0 then 'rights' else 'other' end as reason, case when conv_id % 3 = 0 then 'second' else 'first' end as detail
from (select distinct conv_id from conversations) where conv_id % 2 = 0 or conv_id % 3 = 0""")
def exclusion_log(spark, sf_dir):
    """Every second book is excluded, then every third for another reason; a book has the last one."""
    told = _t(spark, sf_dir, "conversations").select("conv_id").distinct()
    store = tables.Store(tables.scratch(spark, "log"))
    row = lambda n, reason, detail: told.where(F.col("conv_id") % n == 0).select(F.col("conv_id").cast("string").alias("book_id"), F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))
    store.books(row(2, "other", "first"), "excluded")
    return store.books(row(3, "rights", "second"), "excluded")


# -- vectors: embeddings stand for summaries, reversed ones for descriptors; every row whose id is divisible by 20 is a query


def _vectors(spark, sf_dir, vector: str, where: str = "true"):
    return _t(spark, sf_dir, "embeddings").where(where).select(F.col("vec_id").alias("row"), F.expr(vector).alias("v"))


def _queries(spark, sf_dir, parts: list[tuple[int, float]], vector: str = "embedding"):
    """Of each query row, the unit sum of its vector and those of rows after it, by weight; a row that is not there counts as the query's own."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.expr(vector).alias("v"))
    found = rows.where("id % 20 = 0").withColumnsRenamed({"id": "query", "v": "v0"})
    for step, _ in parts:
        if step:
            found = found.join(rows.select((F.col("id") - step).alias("query"), F.col("v").alias(f"v{step}")), "query", "left")
    own = [(F.coalesce(f"v{step}", "v0"), weight) for step, weight in parts]
    return found.select("query", vectors.mixed(own).alias("v"))


def _nearest(spark, sf_dir, rows, queries, k):
    counts = _t(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return search.knn_each(rows, queries, k, counts[0], counts[0] // 20 + 1, counts[1])


def _hits(found):
    return found.select("query", F.col("row").alias("scene_id"), F.round("score", 6).alias("score"))


SIZE = "sqrt(list_sum(list_transform({0}, lambda y: y * y)))"
VECTORS = f"""v as (select vec_id as id, label, cast(embedding as double[]) as sv, list_reverse(cast(embedding as double[])) as dv from embeddings),
unit as (select id, list_transform(sv, lambda x: x / {SIZE.format("sv")}) as u from v),
near as (select q.id as query, q.u as u0, coalesce(a.u, q.u) as u1, coalesce(b.u, q.u) as u2 from unit q
  left join unit a on a.id = q.id + 1 left join unit b on b.id = q.id + 2 where q.id % 20 = 0),
q0 as (select query, u0 as q from near),
mix as (select query, list_transform(list_zip(u0, u1), lambda z: 0.7 * z[1] + 0.3 * z[2]) as m from near),
away as (select query, list_transform(list_zip(u0, u1, u2), lambda z: 0.7 * z[1] + 0.3 * z[2] - 0.5 * z[3]) as m from near)"""
BEST = """s as (select query, v.id as scene_id, round(list_cosine_similarity(v.{vector}, {direction}), 9) as score from v, {queries} {where}),
best as (select query, scene_id, score from s qualify row_number() over (partition by query order by score desc, scene_id) <= {k})"""
RERANKED = """two as (select best.query, best.scene_id, round(0.7 * best.score + 0.3 * list_cosine_similarity(v.dv, d.{direction}), 9) as score
  from best join v on v.id = best.scene_id join {queries} d on d.query = best.query),
final as (select query, scene_id, score from two qualify row_number() over (partition by query order by score desc, scene_id) <= 5)"""
REVERSED = "reverse(embedding)"


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='', k=10)} select query, scene_id, round(score, 6) as score from best")
def knn_cosine(spark, sf_dir):
    return _hits(_nearest(spark, sf_dir, _vectors(spark, sf_dir, "embedding"), _queries(spark, sf_dir, [(0, 1.0)]), 10))


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='where v.label = 4', k=10)} select query, scene_id, round(score, 6) as score from best")
def knn_filtered(spark, sf_dir):
    """The same within one book, which is the fourth label."""
    return _hits(_nearest(spark, sf_dir, _vectors(spark, sf_dir, "embedding", "label = 4"), _queries(spark, sf_dir, [(0, 1.0)]), 10))


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='', k=50)}, {RERANKED.format(direction='q', queries='q0')} select query, scene_id, round(score, 6) as score from final")
def rerank_pool(spark, sf_dir):
    queries = _queries(spark, sf_dir, [(0, 1.0)])
    pool = _nearest(spark, sf_dir, _vectors(spark, sf_dir, "embedding"), queries, search.pool_size(5))
    return _hits(search.reranked_each(pool, _vectors(spark, sf_dir, REVERSED), queries, 5))


@query(f"with {VECTORS}, {BEST.format(vector='dv', direction='m', queries='mix', where='', k=10)} select query, scene_id, round(score, 6) as score from best")
def weighted_centroid(spark, sf_dir):
    queries = _queries(spark, sf_dir, [(0, 0.7), (1, 0.3)])
    return _hits(_nearest(spark, sf_dir, _vectors(spark, sf_dir, REVERSED), queries, 10))


@query(f"with {VECTORS}, {BEST.format(vector='dv', direction='m', queries='away', where='', k=10)} select query, scene_id, round(score, 6) as score from best")
def weighted_anti(spark, sf_dir):
    queries = _queries(spark, sf_dir, [(0, 0.7), (1, 0.3), (2, -0.5)])
    return _hits(_nearest(spark, sf_dir, _vectors(spark, sf_dir, REVERSED), queries, 10))


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='', k=50)}, {RERANKED.format(direction='m', queries='away')} select query, scene_id, round(score, 6) as score from final")
def combined_search(spark, sf_dir):
    pool = _nearest(spark, sf_dir, _vectors(spark, sf_dir, "embedding"), _queries(spark, sf_dir, [(0, 1.0)]), search.pool_size(5))
    terms = _queries(spark, sf_dir, [(0, 0.7), (1, 0.3), (2, -0.5)])
    return _hits(search.reranked_each(pool, _vectors(spark, sf_dir, REVERSED), terms, 5))


# -- the stored index: built from every second vector, the others and a third of those again upserted


def _index(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"), F.col("label").cast("int").alias("label"))
    kind = rows.schema["row"].dataType.simpleString()
    dim = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    index = vector_index.VectorIndex(spark, tables.scratch(spark, "index"), kind, dim, "label int")
    index.build(rows.where("row % 2 = 0").withColumn("v", F.when(F.col("row") % 3 == 0, F.reverse("v")).otherwise(F.col("v"))))
    index.upsert(rows.where("row % 2 = 1 or row % 3 = 0"))
    return index


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='', k=10)} select query, scene_id, round(score, 6) as score from best")
def index_search(spark, sf_dir):
    return _hits(_index(spark, sf_dir).search(_queries(spark, sf_dir, [(0, 1.0)]), 10))


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='where v.label = 4', k=10)} select query, scene_id, round(score, 6) as score from best")
def index_search_filtered(spark, sf_dir):
    return _hits(_index(spark, sf_dir).search(_queries(spark, sf_dir, [(0, 1.0)]), 10, where=F.col("label") == 4))


@query(f"with {VECTORS}, {BEST.format(vector='sv', direction='q', queries='q0', where='', k=50)}, {RERANKED.format(direction='m', queries='away')} select query, scene_id, round(score, 6) as score from final")
def index_combined(spark, sf_dir):
    """The pool from the stored index, reranked by directions away from shunned terms."""
    pool = _index(spark, sf_dir).search(_queries(spark, sf_dir, [(0, 1.0)]), search.pool_size(5))
    terms = _queries(spark, sf_dir, [(0, 0.7), (1, 0.3), (2, -0.5)])
    return _hits(search.reranked_each(pool, _vectors(spark, sf_dir, REVERSED), terms, 5))


@query(f"""with {SCENES} select s.scene_id, e.vec_id, len(e.embedding) as dim,
  round(sqrt(list_sum(list_transform(cast(e.embedding as double[]), lambda x: x * x))), 6) as norm
from scenes s join embeddings e on e.vec_id = cast(s.book_id as bigint)""")
def vectors_with_rows(spark, sf_dir):
    """Every scene with its book's vector, by its length."""
    rows = _t(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", F.col("vec_id").cast("string").alias("book_id"), F.size("embedding").cast("long").alias("dim"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))
    return _scenes(spark, sf_dir).join(rows, "book_id").select("scene_id", "vec_id", "dim", "norm")


def flagship(spark, sf_dir):
    """Documents to paragraphs, chunks and stitched scenes, tallied by the state of the stitch."""
    made = scenes.stitched(scenes.without_noise(_ranges(spark, sf_dir)))
    return made.groupBy("stitch_status").agg(F.count(F.lit(1)).alias("n"))
