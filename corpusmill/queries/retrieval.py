"""Ranking models over ``documents`` with the ``benchmark`` passages as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import retrieval as R
from corpusmill.queries.common import SQL_BM25, SQL_INDEX, Family, asked, docs, document_index, sql_tokens, sql_top, table

FAMILY = Family()
query = FAMILY.query


def _both(spark, sf_dir):
    return document_index(spark, sf_dir), R.query_terms(asked(spark, sf_dir))


@query(f"with {SQL_BM25} {sql_top('bm25', 10)}")
def bm25_top10(spark, sf_dir):
    return R.bm25_top(*_both(spark, sf_dir), 10)


_OKAPI = SQL_INDEX + """,
raw as (select term, ln(n_docs - df + 0.5) - ln(df + 0.5) as i from terms cross join stats),
idf as (select term, case when i < 0 then 0.25 * (select avg(i) from raw) else i end as w from raw),
okapi as (select qid, doc_id, sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from query join postings using (term) join idf using (term) join lengths using (doc_id) cross join stats group by 1, 2)
"""


@query(f"with {_OKAPI} {sql_top('okapi', 10)}")
def bm25_okapi_top10(spark, sf_dir):
    return R.okapi_top(*_both(spark, sf_dir), 10)


_QL = SQL_INDEX + """,
known as (select qid, term, qtf, cf / total as p from query join terms using (term) cross join stats),
base as (select qid, sum(qtf * ln(1000 * p)) as base, sum(qtf) as n from known group by 1),
gain as (select qid, doc_id, sum(qtf * ln(1 + tf / (1000 * p))) as gain from known join postings using (term) group by 1, 2),
ql as (select b.qid, l.doc_id, base - n * ln(dl + 1000) + coalesce(gain, 0) as score
  from base b cross join lengths l left join gain g on g.qid = b.qid and g.doc_id = l.doc_id)
"""


@query(f"with {_QL} {sql_top('ql', 10)}")
def ql_dirichlet_top10(spark, sf_dir):
    return R.query_likelihood_top(*_both(spark, sf_dir), 10)


_RM3 = _QL + """,
first as (select * from (select *, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as k from ql) where k <= 10),
fw as (select qid, doc_id, exp(round(score, 6) - max(round(score, 6)) over (partition by qid)) as w from first),
fn as (select qid, doc_id, w / sum(w) over (partition by qid) as w from fw),
model as (select qid, term, round(sum(w * tf / dl), 9) as s from fn join postings using (doc_id) join lengths using (doc_id) group by 1, 2),
strong as (select * from (select *, row_number() over (partition by qid order by s desc, term) as k from model) where k <= 20),
mixed as (
  select qid, term, 0.5 * qtf / sum(qtf) over (partition by qid) as p from query semi join terms using (term)
  union all select qid, term, 0.5 * s / sum(s) over (partition by qid) from strong),
rm3 as (select qid, term, sum(p) as p from mixed group by 1, 2)
"""


@query(f"with {_RM3} select qid, term, round(p, 6) as weight from rm3")
def rm3_terms(spark, sf_dir):
    return R.rm3_terms(*_both(spark, sf_dir)).select("qid", "term", F.round("qtf", 6).alias("weight"))


@query(f"""with {_RM3}, run as (
  select qid, doc_id, sum(p * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) as score
  from rm3 join postings using (term) join terms using (term) join lengths using (doc_id) cross join stats group by 1, 2)
{sql_top('run', 10)}""")
def rm3_top10(spark, sf_dir):
    index, terms = _both(spark, sf_dir)
    return R.bm25_top(index, R.rm3_terms(index, terms), 10)


_TFIDF = SQL_INDEX + """,
w as (select term, ln((1 + n_docs) / (1 + df)) + 1 as i from terms cross join stats where df >= 2),
dx as (select doc_id, term, (1 + ln(tf)) * i as x from postings join w using (term)),
dn as (select doc_id, sqrt(sum(x * x)) as norm from dx group by 1),
qx as (select qid, term, (1 + ln(qtf)) * i as x from query join w using (term)),
qn as (select qid, sqrt(sum(x * x)) as norm from qx group by 1),
tfidf as (select qid, doc_id, sum(dx.x / dn.norm * (qx.x / qn.norm)) as score
  from dx join dn using (doc_id) join qx using (term) join qn using (qid) group by 1, 2)
"""


@query(f"with {_TFIDF} {sql_top('tfidf', 10)}")
def tfidf_cosine_top10(spark, sf_dir):
    return R.top_k(R.tfidf_cosine(*_both(spark, sf_dir)), 10)


@query(f"""with {SQL_BM25}{_TFIDF[len(SQL_INDEX):]},
a as (select qid, doc_id, score / max(score) over (partition by qid) as a from bm25),
t as (select qid, doc_id, score / max(score) over (partition by qid) as t from tfidf),
run as (select qid, doc_id, 0.5 * coalesce(t, 0) + 0.5 * a as score from a left join t using (qid, doc_id))
{sql_top('run', 10)}""")
def blended_top10(spark, sf_dir):
    return R.top_k(R.blended(*_both(spark, sf_dir)), 10)


_FIRST = "string_split(text, chr(10))[1]"


@query(f"""with {SQL_BM25},
words1 as (select doc_id, unnest({sql_tokens(_FIRST)}) as term from documents),
postings1 as (select doc_id, term, count(*) as tf from words1 group by 1, 2),
lengths1 as (select doc_id, len({sql_tokens(_FIRST)}) as dl from documents),
stats1 as (select count(*) as n_docs, avg(dl) as avgdl from lengths1),
terms1 as (select term, count(*) as df from postings1 group by 1),
field1 as (select qid, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) as score
  from query join postings1 using (term) join terms1 using (term) join lengths1 using (doc_id) cross join stats1 group by 1, 2),
run as (select qid, doc_id, sum(score) as score from (select qid, doc_id, score from bm25 union all select qid, doc_id, 0.5 * score from field1) group by 1, 2)
{sql_top('run', 10)}""")
def multifield_bm25(spark, sf_dir):
    """The whole text, and the first line at half weight."""
    index, terms = _both(spark, sf_dir)
    first = docs(spark, sf_dir).select("doc_id", F.split("text", "\n")[0].alias("text"))
    return R.top_k(R.multi_field({"text": (index, 1.0), "title": (R.build_index(first), 0.5)}, terms), 10)


@query(f"""with {SQL_BM25}, parts as (
  select qid, doc_id, term, tf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) as idf,
    round(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl)), 6) as weight
  from query join postings using (term) join terms using (term) join lengths using (doc_id) cross join stats)
select qid, doc_id, term, tf, idf, weight from (
  select *, row_number() over (partition by qid, doc_id order by weight desc, term) as k from parts
  semi join (select qid, doc_id from ({sql_top('bm25', 1)})) using (qid, doc_id)) where k <= 5""")
def bm25_explained(spark, sf_dir):
    """The five strongest terms of each query's first document."""
    index, terms = _both(spark, sf_dir)
    first = R.bm25_top(index, terms, 1).select("qid", "doc_id")
    parts = R.bm25_parts(index, terms).join(first, ["qid", "doc_id"], "left_semi")
    parts = parts.withColumn("idf", F.round("idf", 6)).withColumn("weight", F.round("weight", 6))
    from pyspark.sql import Window

    order = Window.partitionBy("qid", "doc_id").orderBy(F.desc("weight"), "term")
    return parts.withColumn("k", F.row_number().over(order)).where("k <= 5").drop("k")


_HELD = f"with w as (select distinct doc_id, unnest({sql_tokens('text')}) as term from documents), h as (select doc_id, list(term) as t from w group by 1)"


@query(f"{_HELD} select doc_id from h where list_contains(t, 'the') and (list_contains(t, 'and') or list_contains(t, 'of')) and not list_contains(t, 'was')")
def boolean_and_not(spark, sf_dir):
    return R.boolean(document_index(spark, sf_dir), ["the"], [["and", "of"]], ["was"])


@query(f"""with d as (select doc_id, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as t from documents),
q as (select item_id as qid, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as p from benchmark)
select qid, doc_id from d join q on contains(t, p)""")
def phrase_match(spark, sf_dir):
    """Documents that hold all words of a passage in a row."""
    return R.phrase_matches(docs(spark, sf_dir), asked(spark, sf_dir)).select("qid", "doc_id")


@query(f"with {SQL_INDEX} select term, df, cf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) as idf from terms cross join stats where df >= 5")
def posting_stats(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return index.terms.where("df >= 5").crossJoin(index.stats).select("term", "df", "cf", F.round(R.idf(), 6).alias("idf"))


@query(f"""with {SQL_INDEX}, g as (select doc_id - lag(doc_id, 1, -1) over (partition by term order by doc_id) as gap from postings)
select count(*) as n_postings, count(*) * 32 as raw_bits, sum(8 * greatest(ceil(length(bin(gap)) / 7), 1))::bigint as vbyte_bits,
  sum(2 * length(bin(gap)) - 1)::bigint as gamma_bits from g""")
def index_compression_bits(spark, sf_dir):
    return R.index_sizes(document_index(spark, sf_dir))


@query(f"""with {SQL_BM25}, top as ({sql_top('bm25', 3)}),
lines as (select qid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from top join documents using (doc_id)),
terms_of as (select qid, list(term) as asked from query group by 1),
scored as (select qid, doc_id, line_no, line, len({sql_tokens('line')}) as n, len(list_intersect(list_distinct({sql_tokens('line')}), asked)) as hit_terms
  from lines join terms_of using (qid))
select qid, doc_id, line_no::int as line_no, line, hit_terms::int as hit_terms from (
  select *, row_number() over (partition by qid, doc_id order by round(hit_terms / pow(greatest(n, 1), 0.3), 6) desc, line_no) as k from scored) where k = 1""")
def snippet_best_line(spark, sf_dir):
    index, terms = _both(spark, sf_dir)
    return R.snippets(docs(spark, sf_dir), R.bm25_top(index, terms, 3), terms)


@query(f"""with {SQL_BM25}, p as (select *, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rank, count(*) over (partition by qid) as hits from bm25)
select qid, doc_id, rank::int as rank, hits, ceil(hits / 20)::bigint as pages from p where rank between 21 and 40""")
def second_page(spark, sf_dir):
    """Hits 21 to 40 of each query with the number of pages."""
    run = R.bm25(*_both(spark, sf_dir))
    hits = run.groupBy("qid").agg(F.count("*").alias("hits"))
    return R.top_k(run, 40).where("rank > 20").join(hits, "qid").select("qid", "doc_id", "rank", "hits", F.ceil(F.col("hits") / 20).alias("pages"))


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v),
p as (select a.vec_id as query_id, b.vec_id, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 6) as score from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, vec_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5""")
def knn_cosine_top5(spark, sf_dir):
    """Five nearest vectors by cosine of each query vector."""
    from corpusmill.operators.vectors import nearest

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where("vec_id % 20 = 0"), 5)


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v),
p as (select a.vec_id as query_id, b.label, max(round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 6)) as score from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1, 2)
select query_id, label, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, label) as rank from p) where rank <= 3""")
def maxp_by_label(spark, sf_dir):
    """Groups ranked by their best member."""
    from corpusmill.operators.vectors import best_of_group

    v = table(spark, sf_dir, "embeddings")
    return best_of_group(v, "label", v.where("vec_id % 20 = 0"), 3)


@query(f"""with {SQL_INDEX}, l as (select q.item_id as qid, doc_id, unnest(string_split(d.text, chr(10))) as line, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 as line_no from documents d join benchmark q on d.doc_id % 40 = q.item_id),
t as (select qid, list(term) as asked from query group by 1),
h as (select qid, doc_id, line_no, asked, string_split(line, ' ') as ws, list_transform(string_split(line, ' '), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')) as bare from l join t using (qid))
select qid, doc_id, line_no::int as line_no, array_to_string(list_transform(generate_series(1, len(ws)), lambda i: case when list_contains(asked, bare[i]) then '<em>' || ws[i] || '</em>' else ws[i] end), ' ') as marked,
  case when len(list_intersect(list_distinct(bare), asked)) = 0 then 'none' when len(list_intersect(list_distinct(bare), asked)) = len(asked) then 'full' else 'partial' end as match from h""")
def highlighted_lines(spark, sf_dir):
    """Every line of every document with the words of a benchmark passage marked."""
    lines = docs(spark, sf_dir).select((F.col("doc_id") % 40).alias("qid"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return R.highlighted(lines, R.query_terms(asked(spark, sf_dir)))
