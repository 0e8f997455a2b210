"""Resolution of answers, latent retrieval and measures of generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import plain_tokens, tokens
from corpusmill.operators import resolution as S
from corpusmill.operators import retrieval
from corpusmill.operators.vectors import nearest
from corpusmill.queries.common import SQL_BM25, Family, asked, docs, document_index, sql_plain, sql_tokens, sql_top, table

FAMILY = Family()
query = FAMILY.query


@query()
def answers_resolved(spark, sf_dir):
    """Sentences that name parts, resolved against the parts' names and brands."""
    p = table(spark, sf_dir, "part")
    catalogue = p.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("cluster"), F.lower(F.regexp_replace(F.min_by("p_brand", "p_partkey"), "#", " ")).alias("artist"))
    text = F.concat(F.lit("it must be "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" by "), F.col("p_brand"))).otherwise(F.lit("")))
    return S.resolve_answers(p.select(F.col("p_partkey").alias("id"), text.alias("text")), catalogue, 3)


_GRAMS = "list_transform(generate_series(1, len({c}) - {m}), lambda i: array_to_string({c}[i:i + {m}], ' '))"


def _bleu_sql() -> str:
    parts = []
    for n in range(1, 5):
        said, truth = (_GRAMS.format(c=c, m=n - 1) for c in ("said", "truth"))
        parts.append(f"""s{n} as (select id, g, count(*) as n from (select id, unnest({said}) as g from d) group by 1, 2), u{n} as (select id, g, count(*) as n from (select id, unnest({truth}) as g from d) group by 1, 2),
p{n} as (select coalesce(sum(least(s.n, coalesce(u.n, 0))) / sum(s.n), 0) as p from s{n} s left join u{n} u using (id, g))""")
    return f"""with d as (select doc_id as id, {sql_plain('text')} as said, {sql_tokens('text')} as truth from documents), l as (select sum(len(said)) as c, sum(len(truth)) as r from d), {', '.join(parts)}
select round(case when c >= r then 1.0 else exp(1 - r / c) end * exp((ln(p1.p) + ln(p2.p) + ln(p3.p) + ln(p4.p)) / 4), 6) as bleu, round(p1.p, 6) as p1, round(p2.p, 6) as p2, round(p3.p, 6) as p3, round(p4.p, 6) as p4,
  round(case when c >= r then 1.0 else exp(1 - r / c) end, 6) as brevity from l, p1, p2, p3, p4"""


@query(_bleu_sql())
def bleu_of_plain_text(spark, sf_dir):
    """How close texts without marks come to the texts."""
    return S.bleu(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), plain_tokens(F.col("text")).alias("said"), tokens(F.col("text")).alias("truth")))


_DISTINCT = " union all ".join(f"select {n} as n, unnest({_GRAMS.format(c='t', m=n - 1)}) as g from d" for n in (1, 2, 3))


@query(f"""with d as (select {sql_plain('text')} as t from documents), g as ({_DISTINCT})
select n, count(*) as grams, count(distinct g) as distinct, round(count(distinct g) / count(*), 6) as share from g group by 1""")
def distinct_ngrams(spark, sf_dir):
    return S.distinct_n(docs(spark, sf_dir))


@query(f"""with {SQL_BM25}, r as (select doc_id, (row_number() over (order by n_chars, doc_id) - 1) / greatest(count(*) over () - 1, 1) as share from documents),
run as (select qid, doc_id, 0.8 * score / max(score) over (partition by qid) + 0.2 * share as score from bm25 join r using (doc_id)) {sql_top('run', 10)}""")
def rank_blended_top10(spark, sf_dir):
    """BM25 with a static rank of documents, here their size."""
    run = retrieval.bm25(document_index(spark, sf_dir), retrieval.query_terms(asked(spark, sf_dir)))
    return retrieval.top_k(S.blend_with_rank(run, table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("rank"))), 10)


@query()
def lsa_top10(spark, sf_dir):
    """Documents nearest to each benchmark passage in 20 latent dimensions."""
    v, fold = S.latent_vectors(docs(spark, sf_dir), 20, 1024)
    asked_ = fold(asked(spark, sf_dir).select((-1 - F.col("qid")).alias("doc_id"), "text"))
    rows = lambda d: d.select(F.col("doc_id").alias("vec_id"), F.col("v").alias("embedding"))
    return nearest(rows(v), rows(asked_), 10)
