"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat, line_dedup, mixing, packing, quality_model, quality_rules, secrets, sharding, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public vocabulary that packing uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("lines_").cast("long").alias("n_lines"), F.size("removed_").cast("long").alias("n_removed"),
        F.array_join("removed_", ",").alias("removed_lines"), "text",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"), values=False)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality_model.fit_quality(docs, _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= quality_model.THRESHOLD, 1).otherwise(0)
    return quality_model.score_quality(docs, weights).select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draws: shard:place of each time that the mix takes the document, by epoch, comma-joined."""
    out = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["place"])), ",")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), draws.alias("draws"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("host", "text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), topk.TOP)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled; sizes and check sums are those of the texts in the shards."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    records = _table(spark, sf_dir, "documents").select("*", size)
    return sharding.shuffle_into_shards(records).select(
        F.col("doc_id").cast("long").alias("doc_id"), size, F.crc32(text).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_simhash, op3_secrets, op4_quality, op5_mixing,
        op6_packing, op7_quality_rules, op8_chat, op9_topk, op10_sharding,
    )
}

_LINE_DEDUP = """
with docs as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
every as (select doc_id, unnest(generate_series(1, len(parts))) as lp, parts from docs),
worded as (select doc_id, lp - 1 as lp, trim(parts[lp], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from every),
numbered as (
  select doc_id, lp, line, row_number() over (partition by doc_id order by lp) as pos,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words
  from worded where line <> ''),
summed as (select *, sum(words) over (partition by doc_id order by pos) as upto from numbered),
spans as (
  select s.doc_id, s.pos as a, min(e.pos) as b from summed s join summed e
    on e.doc_id = s.doc_id and e.pos >= s.pos and e.pos < s.pos + 50 and e.upto - s.upto + s.words >= 50 group by 1, 2
  union
  select e.doc_id, max(s.pos) as a, e.pos as b from summed s join summed e
    on e.doc_id = s.doc_id and e.pos >= s.pos and e.pos < s.pos + 50 and e.upto - s.upto + s.words >= 50 group by 1, 3),
texts as (
  select p.doc_id, p.a, p.b, md5(string_agg(n.line, chr(10) order by n.pos)) as content from spans p join numbered n
    on n.doc_id = p.doc_id and n.pos between p.a and p.b group by 1, 2, 3),
placed as (select *, row_number() over (partition by content order by doc_id, a) as copy from texts),
gone as (
  select distinct n.doc_id, n.lp from placed p join numbered n on n.doc_id = p.doc_id and n.pos between p.a and p.b where p.copy > 1),
marked as (select w.doc_id, w.lp, g.lp is not null as cut, w.parts[w.lp + 1] as line
  from (select doc_id, lp - 1 as lp, parts from every) w left join gone g on g.doc_id = w.doc_id and g.lp = w.lp)
select doc_id, count(*) as n_lines, count(*) filter (cut) as n_removed,
  coalesce(string_agg(lp::varchar, ',' order by lp) filter (cut), '') as removed_lines,
  coalesce(string_agg(line, chr(10) order by lp) filter (not cut), '') as text
from marked group by doc_id
"""

_QUALITY_RULES = """
with docs as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from
    (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs)),
windows as (
  select doc_id, i, struct_pack(a := word, b := lead(word) over d, c := lead(word, 2) over d) as win, lead(word, 2) over d as third
  from words window d as (partition by doc_id order by i)),
again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from windows where third is not null) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) t(k) group by 1),
counts as (select doc_id, count(*) as n, sum(length(word)) as chars from words group by 1),
lines as (
  select doc_id, host, unnest(l) as line, generate_subscripts(l, 1) as i from (select doc_id, host, string_split(text, chr(10)) as l from docs)),
worded as (select *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as w from lines),
dups as (
  select doc_id, count(*) filter (k > 1) as n from
    (select doc_id, row_number() over (partition by doc_id, line order by i) as k from worded where len(w) > 0) group by 1),
normal as (
  select doc_id, host, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line, sum(len(w)) as n
  from worded where len(w) > 0 group by 1, 2, 3),
boiler as (select host, line from normal group by 1, 2 having count(*) >= 5),
cut as (select doc_id, sum(n) as n from normal semi join boiler using (host, line) group by 1),
out as (
  select d.doc_id, coalesce(c.n, 0) as n_words, coalesce(c.chars, 0)::bigint as word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(u.n, 0) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words, (coalesce(c.n, 0) - coalesce(x.n, 0))::bigint as left_words
  from docs d left join counts c using (doc_id) left join dups u using (doc_id) left join covered v using (doc_id) left join cut x using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_words >= 50 and left_words >= 0.3 * n_words as kept
from out
"""

_CHAT = """
with turns as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
convs as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls last, role nulls first, text nulls first) as seq from turns group by 1),
firsts as (select conv_id, seq, row_number() over (partition by seq order by conv_id) as k, count(*) over (partition by seq) as copies from convs),
kept as (
  select * from firsts f where k = 1 and not exists (
    select 1 from convs g where len(g.seq) > len(f.seq) and g.seq[1:len(f.seq)] = f.seq))
select conv_id, len(seq) as n_turns, copies,
  array_to_string(list_transform(seq, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)), '') as text
from kept
"""

_TOPK = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 20
"""

ORACLES = {"op1_line_dedup": _LINE_DEDUP, "op7_quality_rules": _QUALITY_RULES, "op8_chat": _CHAT, "op9_topk": _TOPK}
