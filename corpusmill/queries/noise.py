"""Sounds, noise channels, versions and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.sounds import ENDING_SOUNDS, ONSET_SOUNDS, sound_key
from corpusmill.functions.text import tokens
from corpusmill.operators import generation as G
from corpusmill.operators import noise as N
from corpusmill.queries.common import Family, asked, docs, sql_plain, sql_tokens, table

FAMILY = Family()
query = FAMILY.query

_ONSET = "ngh|ng|nh|ch|tr|th|ph|kh|gh|gi|qu|[bcdđghklmnpqrstvx]"
_TONED, _BARE = "áàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ", "aaaaaăăăăăâââââeeeeeêêêêêiiiiioooooôôôôôơơơơơuuuuuưưưưưyyyyy"
_CASES = " ".join(f"when '{a}' then '{b}'" for a, b in ONSET_SOUNDS.items())
_ENDS = " ".join(f"when ends_with(t, '{a}') and length(t) > {len(a)} then t[1:length(t) - {len(a)}] || '{b}'" for a, b in ENDING_SOUNDS.items())


@query(f"""with w as (select distinct unnest({sql_tokens('text')}) as word from documents), n as (select word, translate(word, 'ãẵẫẽễĩõỗỡũữỹ', 'ảẳẩẻểỉỏổởủửỷ') as s from w),
p as (select word, regexp_extract(s, '^({_ONSET})?(.*)$', 1) as onset, regexp_extract(s, '^({_ONSET})?(.*)$', 2) as rest from n),
b as (select *, translate(rest, '{_TONED}', '{_BARE}') as bare from p), g as (select *, onset = 'gi' and not regexp_matches(bare, '^[aăâeêioôơuưy]') as vowel from b),
h as (select word, case when vowel or (onset = 'g' and starts_with(bare, 'i')) then 'd' else case onset {_CASES} else onset end end as head, case when vowel then 'i' || rest else rest end as t from g)
select word, translate(head || case {_ENDS} else t end, 'yýỳỷỹỵ', 'iíìỉĩị') as sound from h""")
def sound_keys(spark, sf_dir):
    """Sound keys of all words."""
    words = docs(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", sound_key(F.col("word")).alias("sound"))


@query()
def noisy_channel(spark, sf_dir):
    """Queries with a fifth of their words changed."""
    return N.noisy_queries(asked(spark, sf_dir), 0.2).select("qid", "text", F.aggregate(F.map_values("ops"), F.lit(0), lambda a, n: a + n).alias("changed"))


@query()
def noise_shares(spark, sf_dir):
    """Shares of the kinds of change."""
    return N.change_counts(N.noisy_queries(docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text"), 0.1))


@query()
def telex_residue(spark, sf_dir):
    return N.telex_residue(docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text"))


def _versions(spark, sf_dir):
    """Texts and the same with two letters merged, as versions."""
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("a"), F.regexp_replace(F.regexp_replace("text", r"\bth", "t"), r"ng\b", "n").alias("b"))




@query()
def version_substitutions(spark, sf_dir):
    """What versions of a text have in each other's place, by kind."""
    return N.word_substitutions(_versions(spark, sf_dir)).groupBy("kind", "old", "new").agg(F.count("*").alias("n"))


@query()
def observed_noise(spark, sf_dir):
    """Queries through the channel that versions show."""
    return N.observed_channel(asked(spark, sf_dir), N.word_substitutions(_versions(spark, sf_dir)), 0.5)


_MARKED = "len(list_filter({t}, lambda w: w <> strip_accents(w)))"


@query(f"""with s as (select doc_id as id, {sql_tokens('text')} as w from documents), r as (select id, case when len(w) > 0 then round({_MARKED.format(t='w')} / len(w), 6) end as share from s)
select id, share, case when share is null then 'empty' when share < 0.05 then 'none' when share < 0.3 then 'partly' else 'fully' end as class from r""")
def mark_use(spark, sf_dir):
    """How far writers use marks."""
    return N.mark_use(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


@query(f"""with p as (select item_id as id, {sql_plain('text')} as a, list_distinct({sql_plain('text')}[1:20]) as b from benchmark), s as (select id, list_distinct(a) as a, b from p)
select id, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 1 end, 6) as similarity from s""")
def version_similarity(spark, sf_dir):
    q = asked(spark, sf_dir)
    cut = F.array_join(F.slice(tokens(F.col("text")), 1, 20), " ")
    return N.version_similarity(q.select(F.col("qid").alias("id"), F.col("text").alias("a"), cut.alias("b")))


@query()
def fragments_by_split(spark, sf_dir):
    """One fragment of each group of equal texts, with the group's split."""
    d = docs(spark, sf_dir)
    return N.one_per_group(G.fragments(d).select("doc_id", "text"), d.select("doc_id", F.md5("text").alias("cluster")))


@query("""with s as (select item_id as id, text, md5('sample:' || item_id) as key from benchmark), f as (select *, row_number() over (order by key, id) as place from s)
select id, place::int as place, 'Describe: ' || text as prompt from f where place <= 15""")
def sampled_prompts(spark, sf_dir):
    """Fifteen items in hash order, as prompts."""
    return N.sampled_items(asked(spark, sf_dir).withColumnRenamed("qid", "id"), 15, "Describe: %s")


@query("""with q as (select item_id as qid, item_id * 3 as doc_id from benchmark), o as (select doc_id, md5(text) as hash from documents),
n as (select case when doc_id % 5 = 0 then doc_id + 100000 else doc_id end as doc_id, md5(text) as hash from documents where doc_id % 7 <> 0),
m as (select hash, min(doc_id) as other from n group by 1), b as (select qid, q.doc_id, o.hash, n.hash as now, other from q left join o using (doc_id) left join n on n.doc_id = q.doc_id left join m on m.hash = o.hash)
select qid, case when hash = now then doc_id else other end as doc_id, case when hash = now then 'kept' when other is not null then 'moved' else 'dropped' end as outcome from b""")
def queries_reattached(spark, sf_dir):
    """Queries whose documents were rebuilt: kept, moved or dropped."""
    old = docs(spark, sf_dir).select("doc_id", F.md5("text").alias("hash"))
    new = old.where("doc_id % 7 <> 0").select(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 100000).otherwise(F.col("doc_id")).alias("doc_id"), "hash")
    return N.reattached(asked(spark, sf_dir).select("qid", (F.col("qid") * 3).alias("doc_id")), old, new)


@query("""with c as (select l_partkey, count(*) as n from lineitem group by 1), r as (select p_partkey as id, p_name as title, n, row_number() over (order by n desc, p_partkey) as place from part join c on l_partkey = p_partkey)
select id, title, n, place::int as place from r where place <= 25""")
def survey_items(spark, sf_dir):
    """The most wanted items, for a survey."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "n")
    first = rows.orderBy(F.desc("n"), "id").limit(25)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "id")))  # 25 rows
