"""Summaries, audits, merges and sets of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import profiles as P
from corpusmill.operators.vectors import nearest

from corpusmill.queries.common import Family, asked, docs, sql_tokens, table
from corpusmill.queries.ranking import _RUNS, _runs

FAMILY = Family()
query = FAMILY.query


@query(f"""with w as (select source, lang, len({sql_tokens('text')}) as w from documents)
select source, lang, count(*) as n, round(avg(w), 6) as mean, quantile_cont(w, 0.5) as median, quantile_cont(w, 0.1) as p10, quantile_cont(w, 0.9) as p90 from w group by 1, 2""")
def lengths_by_source(spark, sf_dir):
    return P.length_profile(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("""with l as (select event_type, (user_id % 5)::varchar as depth, case when value > 50 then 'ok' else 'fail' end as status, value from events),
k as (select 'event_type' as key, event_type as name, value from l union all select 'depth', depth, value from l union all select 'status', status, value from l)
select key, name, count(*) as n, round(avg(value), 6) as mean from k group by 1, 2""")
def crawl_counters(spark, sf_dir):
    """Counters of several columns of a log with the mean of a value."""
    e = table(spark, sf_dir, "events")
    log = e.select("event_type", (F.col("user_id") % 5).alias("depth"), F.when(F.col("value") > 50, "ok").otherwise("fail").alias("status"), "value")
    return P.event_counters(log, ["event_type", "depth", "status"], "value")


@query("select event_type as status, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first, strftime(max(ts), '%Y-%m-%d') as last from events group by 1")
def fetch_dates(spark, sf_dir):
    out = P.date_range(table(spark, sf_dir, "events"), "ts", "event_type")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("""with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where l_returnflag <> 'R')
select count(*) filter (a.k is not null and b.k is not null) as both, count(*) filter (b.k is null) as only_a, count(*) filter (a.k is null) as only_b from a full join b on a.k = b.k""")
def origin_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return P.origin_counts(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), "k")


_NOISE = {"digits": "[0-9]{4,}", "mail": "@", "mark": "[#*$%&|<>]", "doubled": "  "}


@query("with p as (" + " union all ".join(f"select source, '{n}' as pattern, regexp_matches(coalesce(text, ''), '{p}') as hit from documents" for n, p in _NOISE.items()) + ") select source, pattern, count(*) filter (hit) as n from p group by 1, 2")
def leftover_noise(spark, sf_dir):
    """Texts of each source that hold signs of leftover noise."""
    return P.pattern_counts(table(spark, sf_dir, "documents"), "source", _NOISE)


@query(f"""with r as (select doc_id, lang as label, text from documents), h as (select distinct doc_id, label, unnest({sql_tokens('text')}) as term from r),
s as (select label, count(*)::double as m from r group by 1), a as (select label, term, count(*)::double as a from h group by 1, 2), d as (select term, sum(a) as df from a group by 1 having sum(a) >= 5),
c as (select label, term, round((select count(*) from r) * pow(a * ((select count(*) from r) - df - m + a) - (df - a) * (m - a), 2) / nullif(df * ((select count(*) from r) - df) * m * ((select count(*) from r) - m), 0), 6) as chi2 from a join d using (term) join s using (label))
select label, term, chi2, place::int as place from (select *, row_number() over (partition by label order by chi2 desc, term) as place from c where chi2 is not null) where place <= 20""")
def telling_terms(spark, sf_dir):
    """Twenty words that most set each language apart."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    return P.chi_square_terms(rows, 20)


@query("""with s as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events)
select user_id, event_id, before, event_type from s where before <> event_type""")
def change_points(spark, sf_dir):
    """Where a user's events change their kind."""
    return P.change_points(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""with a as (select o_custkey as k, max(o_totalprice) as v, 0 as source_no from orders where o_orderstatus = 'F' group by 1), b as (select c_custkey as k, c_acctbal as v, 1 from customer),
u as (select * from a union all select * from b) select k, v, source_no::int as source_no from (select *, row_number() over (partition by k order by v desc, source_no) as r from u) where r = 1""")
def strongest_record(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return P.strongest_wins([a, b], "k", F.col("v"))


@query("""with u as (select 0 as no, 'r' as source, l_partkey as key from lineitem where l_returnflag = 'R' union all select 1, 'a', l_partkey from lineitem where l_returnflag = 'A' union all select 2, 'part', p_partkey from part),
f as (select key, min(no) as no from u group by 1), g as (select no, count(*) as added from f group by 1)
select source, count(*) as total, coalesce(any_value(added), 0) as added from u left join g using (no) group by 1""")
def merge_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return P.merge_report({"r": rows.where("l_returnflag = 'R'"), "a": rows.where("l_returnflag = 'A'"), "part": part}, "key")


@query("select count(*) as n, true as equal from orders")
def merge_verified(spark, sf_dir):
    """A table and its rows dealt anew have one checksum."""
    o = table(spark, sf_dir, "orders")
    other = P.checksum(o.repartition(7, "o_custkey")).select("n", F.col("sum").alias("other"))
    return P.checksum(o).join(other, "n").select("n", (F.col("sum") == F.col("other")).alias("equal"))


@query("""with g as (select doc_id, md5(coalesce(text, '')) as c from documents), f as (select c, min(doc_id) as v from g group by 1), o as (select doc_id, v as version from g join f using (c) where doc_id <> v)
select * from o union all select version, doc_id from o""")
def version_links(spark, sf_dir):
    """Copies of a text and its first document, in both directions."""
    return P.version_links(docs(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("cluster")))


@query("""with g as (select doc_id, source as c, n_chars from documents), h as (select distinct c from g where doc_id % 17 = 3)
select doc_id, n_chars from g anti join h using (c) where c is not null""")
def outside_pilot(spark, sf_dir):
    """Documents of sources from which no pilot document came."""
    d = table(spark, sf_dir, "documents")
    groups = d.where("source is not null").select("doc_id", F.col("source").alias("cluster"))
    return P.without_groups(d.select("doc_id", "n_chars"), groups, d.where("doc_id % 17 = 3").select("doc_id"))


_JUDGED = "j as (select o_custkey % 50 as qid, o_orderkey % 400 - 5 as doc_id, case when o_orderstatus = 'F' then 1 else 0 end as grade from orders)"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("qid"), (F.col("o_orderkey") % 400 - 5).alias("doc_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("grade"))


@query(f"""with {_JUDGED}, r as (select qid, doc_id, count(*) as n, max(grade) as grade from j group by 1, 2)
select qid, sum(n)::bigint as judged, sum(n - 1)::bigint as repeated, count(*) filter (d.doc_id is null) as unknown, count(*) filter (grade > 0) as relevant, count(*) filter (grade > 0) < 2 as thin
from r left join documents d using (doc_id) group by 1""")
def judgement_audit(spark, sf_dir):
    return P.judgement_audit(_judged(spark, sf_dir), docs(spark, sf_dir))


@query(f"""with {_RUNS}, {_JUDGED} select qid, doc_id, rank::int as rank from runs where system = 'bm25' and rank <= 10 and qid in (select qid from j) and (qid, doc_id) not in (select (qid, doc_id) from j)""")
def unjudged_hits(spark, sf_dir):
    """Found documents that nobody judged."""
    return P.unjudged_lookalikes(_runs(spark, sf_dir).where("system = 'bm25'"), _judged(spark, sf_dir), 10)


@query(f"""with d as (select doc_id, array_to_string({sql_tokens('text')}, ' ') as t from documents), p as (select item_id as qid, array_to_string(({sql_tokens('text')})[1:2], ' ') as p from benchmark where item_id < 20)
select qid, doc_id, t = p as exact from d join p on contains(' ' || t || ' ', ' ' || p || ' ')""")
def whole_phrase_hits(spark, sf_dir):
    """Texts that hold one of twenty phrases of two words."""
    few = table(spark, sf_dir, "benchmark").where("item_id < 20").select(F.col("item_id").alias("qid"), F.array_join(F.slice(tokens(F.col("text")), 1, 2), " ").alias("text"))
    return P.whole_phrase_hits(docs(spark, sf_dir), few)


@query("""with q as (select item_id as qid, text, case when item_id % 3 = 0 then null else item_id - item_id % 3 end as origin from benchmark)
select q.qid, q.text, coalesce(o.text, q.text) as gold from q left join q o on o.qid = q.origin""")
def gold_texts(spark, sf_dir):
    q = asked(spark, sf_dir)
    return P.gold_texts(q.withColumn("origin", F.when(F.col("qid") % 3 != 0, F.col("qid") - F.col("qid") % 3)))


@query("""with p as (select conv_id as thread, conv_id * 1000 + turn as post_id, turn as n, case when turn % 2 = 1 then conv_id * 1000 + turn - 1 when turn % 4 = 2 then conv_id * 1000 + turn + 1 end as quotes from conversations)
select a.post_id, b.post_id as reply_id from p a join p b on a.thread = b.thread and b.quotes = a.post_id where a.n < b.n""")
def quoting_replies(spark, sf_dir):
    """Posts with later posts that quote them."""
    c = table(spark, sf_dir, "conversations")
    post = F.col("conv_id") * 1000 + F.col("turn")
    quotes = F.when(F.col("turn") % 2 == 1, post - 1).when(F.col("turn") % 4 == 2, post + 1)
    return P.quoting_replies(c.select(F.col("conv_id").alias("thread"), post.alias("post_id"), F.col("turn").alias("n"), quotes.alias("quotes")))


@query("""with r as (select p_partkey as id, case when p_partkey % 7 = 0 then '  ' else p_name end as title, p_brand || ' | site' as brand from part),
f as (select id, nullif(trim(title), '') as name, regexp_replace(brand, ' \\| site$', '') as brand from r) select id, name, brand from (select *, row_number() over (partition by name, brand order by id) as k from f) where k = 1""")
def repaired_rows(spark, sf_dir):
    """A renamed column, blanks as null, a suffix stripped, repeated rows out."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.concat("p_brand", F.lit(" | site")).alias("brand"))
    return P.repaired_columns(rows, ["name", "brand"], {"title": "name"}, ["name"], {"brand": r" \| site"})


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as l from v),
p as (select a.vec_id as doc_id, b.vec_id as other, round(list_inner_product(a.e, b.e) / (a.l * b.l), 6) as score from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
s as (select doc_id, other, score from (select *, row_number() over (partition by doc_id order by score desc, other) as r from p) where r <= 5),
t as (select vec_id as doc_id, 't' || label as tag, count(*) as c from embeddings where vec_id % 3 = 0 group by 1, 2),
w as (select s.doc_id, t.tag, round(sum(score * c), 6) as weight from s join t on t.doc_id = s.other group by 1, 2), m as (select w.* from w anti join t using (doc_id, tag))
select doc_id, tag, weight, place::int as place from (select *, row_number() over (partition by doc_id order by weight desc, tag) as place from m) where place <= 2""")
def inferred_tags(spark, sf_dir):
    """Tags that similar vectors have."""
    v = table(spark, sf_dir, "embeddings")
    similar = nearest(v.select("vec_id", "embedding"), v.where("vec_id % 20 = 0").select("vec_id", "embedding"), 5)
    similar = similar.select(F.col("query_id").alias("doc_id"), F.col("vec_id").alias("other"), "score")
    tags = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("tag"))
    return P.inferred_tags(tags, similar, 2)
