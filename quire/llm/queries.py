"""Queries over the given tables, one for each operator of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, embedding_dedup, language_id, lexical_search, license_scan, manifest, packing, quality_rules, sharding, simhash, suffix_dedup, token_counts, toxicity
from quire.llm.common import small_batches, work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("license.sentences", ",").alias("sentences"),
        F.array_join("license.rules", ",").alias("rules"),
        F.array_join("license.licenses", ",").alias("licenses"),
        "license.restricted",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        work_path(spark, "token-cache"),
        limit=512,
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"), words=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fitted = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    found = toxicity.score(docs, fitted)
    return found.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.flagged").alias("flagged_by_language"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.where(~language_id.held_out()))
    return found.select(
        "doc_id",
        language_id.held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        "found.n_items",
        "found.items_sha256",
        decontaminate.contaminated("found").alias("contaminated"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in manifest.COLUMNS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, manifest.leaf(*(columns | {"n_chars": F.col("n_chars") + 1}).values()))
    found = manifest.manifest(docs, keep={"tampered": tampered})
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.siblings(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.screen(_table(spark, sf_dir, "documents")).select("doc_id", "quality.*")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_lexical_search": op13_lexical_search,
}

_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_OP9 = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as p from i where len(w) > 0)),
lens as (select distinct n from win),
grams as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n)),
hits as (select doc_id, p, n, item_id from grams join win using (n, s)),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1),
its as (select doc_id, count(distinct item_id) as n_items,
  string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from hits group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)"""
_OP10 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
least_ as (select x, min(y) as m from reach group by 1), n as (select x, count(*) as n from links group by 1)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id,
  vec_id <= coalesce(m, vec_id) as kept
from embeddings left join least_ l on l.x = vec_id left join n on n.x = vec_id"""

_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in manifest.COLUMNS)
_TAMPERED = " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in manifest.COLUMNS)
_CRC32 = """xor(list_reduce([cast(ascii(c) as bigint) for c in string_split({0}, '')],
  lambda s, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(s, b)), cast(4294967295 as bigint)), 4294967295)"""
_OP11 = f"""
with recursive leaves as (select doc_id, coalesce('=' || lang, '-') as g, sha256({_LEAF}) as h,
    case when {_CRC32.format("cast(doc_id as varchar)")} % 7 = 0 then sha256({_TAMPERED}) end as t from documents),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as slot from leaves),
nodes(g, level, slot, h, n) as (
  select g, 0, slot, h, count(*) over (partition by g) from placed
  union all
  select g, any_value(level) + 1, slot // 2, sha256(string_agg(h, '' order by slot)), any_value(n + 1) // 2 from nodes where n > 1 group by g, slot // 2),
subroots as (select g, h, row_number() over (order by g) - 1 as slot from nodes where n = 1),
tops(level, slot, h, n) as (
  select 0, slot, h, count(*) over () from subroots
  union all
  select any_value(level) + 1, slot // 2, sha256(string_agg(h, '' order by slot)), any_value(n + 1) // 2 from tops where n > 1 group by slot // 2),
depth as (select g, count(distinct level) - 1 as levels from nodes group by g),
low as (select p.g, p.slot, k.level, (p.slot >> k.level) % 2 = 1 as right_, s.h from placed p join depth d using (g)
  cross join (select distinct level from nodes) k left join nodes s on s.g = p.g and s.level = k.level and s.slot = xor(p.slot >> k.level, 1) where k.level < d.levels),
high as (select r.g, k.level, (r.slot >> k.level) % 2 = 1 as right_, s.h from subroots r cross join (select distinct level from tops where n > 1) k
  left join tops s on s.level = k.level and s.slot = xor(r.slot >> k.level, 1)),
steps as (select g, slot, level as lv, right_, h from low
  union all select p.g, p.slot, d.levels + high.level, right_, high.h from placed p join depth d using (g) join high using (g)),
proofs as (select g, slot, list(struct_pack(r := right_, h := coalesce(h, '')) order by lv) as proof from steps group by all),
folded as (select doc_id, p.g, p.slot, p.h as leaf, coalesce(proof, []) as proof, coalesce(t, p.h) as start from placed p left join proofs using (g, slot)),
walk(doc_id, g, slot, leaf, proof, own, lv) as (
  select doc_id, g, slot, leaf, proof, start, 1 from folded
  union all
  select doc_id, g, slot, leaf, proof, sha256(case when proof[lv].r then proof[lv].h || own else own || proof[lv].h end), lv + 1 from walk where lv <= len(proof)),
ended as (select * from walk where lv = len(proof) + 1)
select doc_id, leaf, s.h as subroot, t.h as root, sha256(array_to_string([x.h for x in proof], '')) as proof_sha256, own as folded_root, own = t.h as verified
from ended join subroots s using (g), (select h from tops where n = 1) t"""

_SPACE = "\\x20\\x09-\\x0D"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP12 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce('=' || source, '-') as host from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') as w from d),
grams as (select r, p, array_to_string(w[p:p + 2], ' ') as s from (select r, w, unnest(range(1, len(w) - 1)) as p from w)),
twice as (select r, s from grams group by 1, 2 having count(*) > 1),
repeated as (select r, count(distinct q) as n from (select r, unnest(range(p, p + 3)) as q from grams join twice using (r, s)) group by 1),
lines as (select r, host, text, unnest(string_split(text, chr(10))) as line from d),
plain as (select r, host, text, line, trim(regexp_replace({_LOWER.format("line")}, '[{_SPACE}]+', ' ', 'g'), ' ') as p from lines),
had as (select * from plain where p <> ''),
dups as (select r, count(*) - count(distinct line) as n from had group by 1),
common as (select host, p from had group by 1, 2 having count(distinct text) > {quality_rules.MAX_DOCS}),
gone as (select r, sum(len(string_split(p, ' '))) as words, count(distinct p) as n from had semi join common using (host, p) group by 1),
f as (select w.doc_id, len(w) as n_words, coalesce(list_sum([length(x) for x in w]), 0) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words,
  coalesce(gone.n, 0) as n_common_lines, len(w) - coalesce(gone.words, 0) as n_left
  from w left join repeated using (r) left join dups using (r) left join gone using (r)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and n_left >= {quality_rules.MIN_WORDS} and n_left >= {quality_rules.MIN_LEFT} * n_words as kept,
  cast(n_common_lines as bigint) as n_common_lines, cast(n_left as bigint) as n_left_words from j"""

_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_OP13 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERMS}') as w from documents where text is not null),
tf as (select r, doc_id, len(w) as n, t, count(*) as tf from (select r, doc_id, w, unnest(w) as t from d) group by all),
totals as (select count(*) as docs, sum(len(w)) as total from d where len(w) > 0),
df as (select t, count(*) as df from tf group by 1),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}')) as t from benchmark),
weights as (select item_id, t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from q join df using (t), totals),
scores as (select item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) as score
  from weights join tf using (t), totals group by item_id, r)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls first, r) as rank from scores where score > 0) where rank <= 10"""

#: DuckDB SQL for the queries that SQL can express. It has no XXH64, tokenizers, trained models or bin packing.
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op9_decontamination": _OP9,
    "op10_embedding_dedup": _OP10,
    "op11_merkle_manifest": _OP11,
    "op12_quality_rules": _OP12,
    "op13_lexical_search": _OP13,
}
