"""Records of pages, posts of threads, names and groups of clusters, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import clusters as C
from corpusmill.operators import records as R
from corpusmill.queries.common import Family, docs, sql_tokens, table
from corpusmill.queries.ranking import _runs

FAMILY = Family()
query = FAMILY.query

_LD = '<script type="application/ld+json">{"@graph":[{"@type":"Article","name":" %s ","author":[{"name":"%s"}],"text":"%s"}]}</script>'


def _pages(spark, sf_dir):
    """Pages of three kinds: with structured data, with a labelled author, and as they are."""
    p = table(spark, sf_dir, "pages")
    data = F.format_string(_LD, F.concat(F.lit("T"), "page_id"), F.concat(F.lit("A"), F.col("page_id") % 5), F.concat(F.lit("body of "), "page_id"))
    label = F.concat(F.lit("<table><tr><td>Author:</td><td><b>B"), F.col("page_id") % 4, F.lit("</b></td></tr></table>"))
    k = F.col("page_id") % 3
    return p.select("page_id", F.when(k == 0, F.concat("html", data)).when(k == 1, F.concat("html", label)).otherwise(F.col("html")).alias("html"))


@query(r"""with p as (select page_id, html, page_id % 3 as k from pages),
c as (select *, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\s+', ' ', 'g')) as h1 from p)
select page_id, case when k = 0 then 'T' || page_id when h1 <> '' then h1 end as title, case k when 0 then 'A' || (page_id % 5) when 1 then 'B' || (page_id % 4) end as author,
  case when k = 0 then 'data' when h1 <> '' then 'heading' end as title_from from c""")
def page_records(spark, sf_dir):
    """Titles and authors of pages, and which source gave them."""
    return R.page_records(_pages(spark, sf_dir)).select("page_id", "title", "author", "title_from")


def _threads(spark, sf_dir):
    """Conversations as forum pages."""
    c = table(spark, sf_dir, "conversations")
    post = F.col("conv_id") * 1000 + F.col("turn")
    quote = F.when(F.col("turn") > 0, F.format_string('<blockquote data-source="post: %d"><a href="/x">q</a> quoted</blockquote>', post - 1)).otherwise("")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    article = F.format_string('<article data-author="%s" data-content="post-%d"><time datetime="2024-01-%02d">x</time>%s<p>%s</p><a href="/p">p</a></article>', "role", post, (F.col("turn") % 28 + 1).cast("int"), quote, text)
    rows = c.select("conv_id", F.struct("turn", article.alias("a")).alias("t"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["a"]), "\n")
    return rows.groupBy(F.col("conv_id").alias("thread")).agg(F.concat(body, F.lit('<a href="/t/page-2">2</a><a href="/t/page-7">7</a>')).alias("html"))


@query(r"""select conv_id as thread, (row_number() over (partition by conv_id order by turn) - 1)::int as n, conv_id * 1000 + turn as post_id, role as author, '2024-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') as at,
  case when turn > 0 then conv_id * 1000 + turn - 1 end as quotes, 1::bigint as links, trim(regexp_replace(text || ' p', '\s+', ' ', 'g')) as text, 7 as last_page from conversations""")
def thread_posts(spark, sf_dir):
    """Posts read back from forum pages."""
    return R.thread_posts(_threads(spark, sf_dir))


@query(f"""with w as (select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by 1, 2),
i as (select term, count(*) as df from w group by 1 having count(*) >= 2), c as (select doc_id, lang as cluster from documents), z as (select cluster, count(*) as size from c group by 1),
m as (select cluster, term, size, round(sum((1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1)) / size, 6) as w from w join i using (term) join c using (doc_id) join z using (cluster)
  where length(term) >= 2 and regexp_full_match(term, '\\p{{L}}+') and term <> 'the' group by 1, 2, 3),
r as (select *, row_number() over (partition by cluster order by w desc, term) as place from m)
select cluster, coalesce(string_agg(term, ' · ' order by place), '') as name, any_value(size) as size from r where place <= 3 group by 1""")
def cluster_names(spark, sf_dir):
    """The languages named by their words."""
    groups = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cluster"))
    return C.cluster_names(docs(spark, sf_dir), groups, 3, ("the",))


@query()
def grouped_results(spark, sf_dir):
    """First results of each query in groups by vectors."""
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.max("vec_id").alias("last"))
    run = _runs(spark, sf_dir).where("system = 'bm25'").crossJoin(n).select("qid", F.pmod("doc_id", F.col("last") + 1).alias("doc_id"), "rank").groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    return C.result_clusters(run, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")))


@query()
def merge_steps(spark, sf_dir):
    """The first merges of the mean vectors of labels."""
    v = table(spark, sf_dir, "embeddings")
    each = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    means = each.groupBy(F.col("label").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return C.merge_steps(means, 5)


@query()
def minhash_errors(spark, sf_dir):
    """Error of MinHash with 16, 64 and 128 permutations on near pairs."""
    return C.estimate_errors(docs(spark, sf_dir))


@query()
def band_recall(spark, sf_dir):
    """Recall of the bands, measured against all similar pairs."""
    return C.band_recall(docs(spark, sf_dir))
