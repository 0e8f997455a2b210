"""Relational operators over the star schema, ``pages``, ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import relational as R
from corpusmill.operators import retrieval
from corpusmill.queries.common import SQL_BM25, Family, asked, docs, sql_top, table

FAMILY = Family()
query = FAMILY.query


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("""with r as (select o_custkey, o_orderstatus, o_totalprice, o_orderkey from orders),
n as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as k from r)
select o_custkey, any_value(o_orderstatus) filter (k = 1) as o_orderstatus, min(o_totalprice) as o_totalprice from n group by 1""")
def upsert_min_depth(spark, sf_dir):
    """Later rows overwrite, the price keeps its minimum."""
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey")
    return R.upsert(rows, "o_custkey", "o_orderkey", least=["o_totalprice"]).drop("o_orderkey")


@query("""with r as (select o_custkey, o_orderkey, case when o_orderstatus = 'P' then null else o_orderpriority end as p, o_totalprice from orders)
select o_custkey, arg_max(o_totalprice, o_orderkey) as price, arg_max(p, o_orderkey) filter (p is not null) as p from r group by 1""")
def upsert_partial(spark, sf_dir):
    """Null values don't overwrite."""
    p = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), p.alias("p"))
    return R.upsert(rows, "o_custkey", "o_orderkey", keep_known=["p"]).drop("o_orderkey")


@query("""select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'N' except
select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'""")
def insert_ignore_links(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    known = pairs.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return R.insert_ignore(known, pairs.where("l_returnflag = 'N'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("""with u as (select 0 as source_no, o_custkey as k, o_orderkey as id from orders where o_orderstatus = 'F'
  union all select 1, o_custkey, o_orderkey from orders where o_orderstatus = 'O' union all select 2, c_custkey, c_custkey from customer),
f as (select * from (select *, row_number() over (partition by k order by source_no, id) as r from u) where r = 1)
select k, id, source_no, row_number() over (order by source_no, id) as new_id from f""")
def merge_priority_union(spark, sf_dir):
    """Three sources in order, one row a key, numbered on."""
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"))
    return R.merge_in_order([o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), c], "k", "id")


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'F')")
def anti_pending(spark, sf_dir):
    done = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("""with b as (select o_custkey, max(o_totalprice) as m from orders where o_orderstatus = 'P' group by 1)
select c_custkey, coalesce(m, c_acctbal) as balance from customer left join b on o_custkey = c_custkey""")
def coalesce_update(spark, sf_dir):
    """A correlated update as a left join."""
    best = _orders(spark, sf_dir).where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return table(spark, sf_dir, "customer").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("m", "c_acctbal").alias("balance"))


@query("""select n_name, count(*) as n_customers, count(distinct c_mktsegment) as segments, round(sum(c_acctbal), 2) as balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA' group by 1""")
def nation_summary(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name <> 'ASIA'"), n.n_regionkey == r.r_regionkey)
    return rows.groupBy("n_name").agg(
        F.count("*").alias("n_customers"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("""with p as (select p_partkey as id, p_brand as x, string_split(p_name, ' ')[1] as b, p_retailprice as s from part),
m as (select a.id as l_id, c.id as r_id, abs(a.s - c.s) as diff, a.x = c.x as same from p a join p c on a.b = c.b and a.id <> c.id),
r as (select *, case when same and diff <= 3 then 0 when same and diff <= 20 then 1 when diff <= 60 then 2 end as rule from m)
select l_id, r_id, rule, diff from (select *, row_number() over (partition by l_id order by rule, diff, r_id) as k from r where rule is not null) where k = 1""")
def ranked_match_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("x"), F.split("p_name", " ")[0].alias("b"), F.col("p_retailprice").alias("s")
    )
    return R.match_cascade(p, p, "b", "x", "s", 3.0, 20.0)


@query("""select a.p_partkey as l_id, b.p_partkey as r_id from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey
and contains(' ' || a.p_name || ' ', ' ' || string_split(b.p_name, ' ')[1] || ' ') and a.p_size = b.p_size""")
def whole_word_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")  # a first word holds no space: it stands whole in a name as one of its words
    a = p.select(F.col("p_partkey").alias("l_id"), "p_brand", "p_size", words)
    b = p.select(F.col("p_partkey").alias("r_id"), "p_brand", "p_size", F.split("p_name", " ")[0].alias("word"))
    return a.join(b, ["p_brand", "p_size", "word"]).where("l_id <> r_id").select("l_id", "r_id")


_FACETS = "select 'brand' as attribute, p_brand as value from part union all select 'type', p_type from part union all select 'word', unnest(list_distinct(string_split(p_name, ' '))) from part"


@query(f"""with f as ({_FACETS}), c as (select attribute, value, count(*) as n from f group by 1, 2)
select attribute, value, n from (select *, row_number() over (partition by attribute order by n desc, value) as k from c) where k <= 10""")
def facet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("word")
    )
    return R.top_values(rows, ["brand", "type", "word"], 10)


@query("""select p_type, count(*) as n, min(p_partkey) as first_part from part
where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') and p_size in (1, 2, 3, 4, 5) group by 1""")
def facet_filtered(spark, sf_dir):
    rows = R.with_facets(table(spark, sf_dir, "part"), {"p_brand": ["Brand#1", "Brand#2", "Brand#3"], "p_size": [1, 2, 3, 4, 5]})
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""select p_brand as value, count(*) as n from part where contains(lower(p_brand), 'd#1') group by 1 order by n desc, value limit 10""")
def facet_value_search(spark, sf_dir):
    counts = table(spark, sf_dir, "part").where(F.lower("p_brand").contains("d#1")).groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(10)


@query(f"""with {SQL_BM25}, run as ({sql_top('bm25', 50)}), o as (select doc_id, md5(text) as h from documents), g as (select doc_id, min(doc_id) over (partition by h) as cluster from o),
f as (select qid, cluster, arg_min(doc_id, rank) as doc_id, min(rank) as first_rank, count(*) as versions from run join g using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by qid order by first_rank) as place from f)
select qid, doc_id, cluster, versions, place::int as rank from r where place <= 10""")
def collapse_versions(spark, sf_dir):
    """Equal texts shown once, with their number."""
    d = docs(spark, sf_dir)
    run = retrieval.bm25_top(retrieval.build_index(d), retrieval.query_terms(asked(spark, sf_dir)), 50)
    keyed = d.select("doc_id", F.md5("text").alias("h"))
    groups = keyed.join(keyed.groupBy("h").agg(F.min("doc_id").alias("cluster")), "h").select("doc_id", "cluster")
    return R.collapse(run.select("qid", "doc_id", "rank"), groups, 10)


@query("""with e as (select event_type as s, count(*) as n from events where starts_with(event_type, 'v') or starts_with(event_type, 'p') group by 1),
t as (select distinct p_name as s from part where starts_with(p_name, 'p'))
select s as suggestion, kind, place from (
  select s, 'popular' as kind, row_number() over (order by n desc, s)::int as place from e
  union all select s, 'title', row_number() over (order by s)::int from t where s not in (select s from e)) where place <= 8""")
def suggest_prefix(spark, sf_dir):
    """Popular entries with a prefix first, then titles."""
    e = table(spark, sf_dir, "events").where("startswith(event_type, 'v') or startswith(event_type, 'p')").groupBy(F.col("event_type").alias("suggestion")).agg(F.count("*").alias("n"))
    t = table(spark, sf_dir, "part").where("startswith(p_name, 'p')").select(F.col("p_name").alias("suggestion")).distinct()
    popular = e.orderBy(F.desc("n"), "suggestion").limit(8).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "suggestion")))
    titles = t.join(e, "suggestion", "left_anti").orderBy("suggestion").limit(8).withColumn("place", F.row_number().over(Window.orderBy("suggestion")))
    return popular.select("suggestion", F.lit("popular").alias("kind"), "place").unionByName(titles.select("suggestion", F.lit("title").alias("kind"), "place"))


@query("""with h as (select doc_id, sha256(text) as h from documents) select min(doc_id) as doc_id, count(*) as copies from h group by h""")
def exact_dups(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""with h as (select doc_id, source, md5(text) as h from documents), g as (select h, count(*) as size, count(distinct source) as sources, min(doc_id) as group_id from h group by 1)
select doc_id, group_id, size, sources from h join g using (h) where size > 1""")
def dup_marking(spark, sf_dir):
    """Copies get a group and stay."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    groups = keyed.groupBy("h").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("group_id")).where("size > 1")
    return keyed.join(groups, "h").select("doc_id", "group_id", "size", "sources")


@query("""with g as (select count(*) as size, count(distinct source) > 1 as mixed from documents group by md5(text)) select size, count(*) as n_groups, count(*) filter (mixed) as n_mixed from g group by 1""")
def dup_group_sizes(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("size"), F.count_distinct("source").alias("s"))
    return groups.groupBy("size").agg(F.count("*").alias("n_groups"), F.count_if(F.col("s") > 1).alias("n_mixed"))


@query("""select p_name, p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) as kept, count(*) as n from part group by 1, 2""")
def keep_longest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(
        F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey")).alias("kept"), F.count("*").alias("n")
    )


@query("""with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2)
select o_custkey, o_orderpriority, n from (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as k from c) where k = 1""")
def majority_key(spark, sf_dir):
    counts = _orders(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderpriority", "n"), F.struct(-F.col("n"), "o_orderpriority")).alias("b")).select("o_custkey", "b.*")


@query("select source, arg_min(doc_id, (-n_chars, doc_id)) as doc_id, max(n_chars) as n_chars from documents where lang <> 'es' group by 1")
def representative_row(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang <> 'es'")
    return rows.groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by md5('7:' || o_orderkey), o_orderkey) as k from orders) where k <= 50""")
def stratified_sample(spark, sf_dir):
    key = F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")))
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(key, "o_orderkey"))
    return _orders(spark, sf_dir).withColumn("k", rank).where("k <= 50").select("o_custkey", "o_orderkey")


@query("""select regexp_extract(url, '://([^/]+)', 1) as group_key, count(*) as n_rows, round(100.0 * count(*) filter (trim(url) <> '') / count(*), 4) as url_percent,
  round(100.0 * count(*) filter (trim(regexp_extract(html, '<title>([^<]*)', 1)) <> '') / count(*), 4) as title_percent from pages group by 1""")
def completeness_by_domain(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return R.completeness(rows, F.regexp_extract("url", "://([^/]+)", 1), ["url", "title"])


@query("""with p as (select distinct l_orderkey, l_partkey from lineitem)
select a.l_partkey as a, b.l_partkey as b, count(*) as n from p a join p b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2 having count(*) >= 2""")
def co_occurring_parts(spark, sf_dir):
    """Unordered pairs that share an order. An order has a handful of lines, so pairs stay in proportion."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    pairs = F.explode(F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return lines.select(pairs.alias("q")).groupBy("q.a", "q.b").agg(F.count("*").alias("n")).where("n >= 2")


@query("""with c as (select p_type as tag, count(*) as n from part group by 1) select tag, n, round(0.9 + 1.4 * ln(1 + n) / ln(1 + max(n) over ()), 6) as size from c order by n desc, tag limit 80""")
def tag_cloud(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("m"))
    size = F.round(0.9 + 1.4 * F.log1p("n") / F.log1p("m"), 6)
    return counts.crossJoin(most).select("tag", "n", size.alias("size")).orderBy(F.desc("n"), "tag").limit(80)


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupingSets(
        [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus"
    ).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""with s as (select l_suppkey, string_agg(l_partkey::varchar, ',' order by l_partkey) as vec from (select distinct l_suppkey, l_partkey from lineitem) group by 1)
select min(l_suppkey) as kept, count(*) as n from s group by vec""")
def identical_runs(spark, sf_dir):
    """Rows whose whole ranking is the same are kept once."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("v"))
    return rows.groupBy(F.md5(F.array_join("v", ",")).alias("h")).agg(F.min("l_suppkey").alias("kept"), F.count("*").alias("n")).drop("h")


@query("""with a as (select s_suppkey, s_name, l_partkey from supplier join (select distinct l_suppkey, l_partkey from lineitem) on l_suppkey = s_suppkey),
c as (select s_suppkey, any_value(s_name) as name, count(*) as n from a group by 1)
select count(*) as suppliers, count(*) filter (n >= 30) as ready, count(*) filter (n >= 24) as nearly, max(n) as most from c""")
def readiness(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    counts = pairs.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")).join(table(spark, sf_dir, "supplier"), "s_suppkey")
    return counts.agg(F.count("*").alias("suppliers"), F.count_if(F.col("n") >= 30).alias("ready"), F.count_if(F.col("n") >= 24).alias("nearly"), F.max("n").alias("most"))


@query("""with s as (select c_custkey, c_nationkey, c_acctbal > 0 as p1, c_mktsegment = 'BUILDING' as p2, c_nationkey < 10 as p3 from customer)
select count(*) filter (p1) as positive, count(*) filter (p2) as building, count(*) filter (p3) as early, count(*) filter (p1 and p2 and p3) as everything from s""")
def predicate_sets(spark, sf_dir):
    """The size of each predicate's set and of their conjunction, in one pass."""
    p = [F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 10]
    return table(spark, sf_dir, "customer").agg(
        F.count_if(p[0]).alias("positive"), F.count_if(p[1]).alias("building"), F.count_if(p[2]).alias("early"), F.count_if(p[0] & p[1] & p[2]).alias("everything")
    )
