"""Fusion and evaluation: benchmark passages as known-item queries, documents that hold them as targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import char_ngrams_padded, plain_tokens, tokens
from corpusmill.operators import evaluation as E
from corpusmill.operators import fusion, retrieval
from corpusmill.plans.durable import Scratch
from corpusmill.queries.common import SQL_BM25, Family, asked, docs, document_index, sql_plain, sql_tokens, sql_top, table

FAMILY = Family()
query = FAMILY.query


def _runs(spark, sf_dir, depth=20):
    """bm25 over marked words, plain over words without marks."""
    q, out = asked(spark, sf_dir), None
    for name, analyse in (("bm25", tokens), ("plain", plain_tokens)):
        terms = analyse(F.col("text"))
        run = retrieval.bm25_top(document_index(spark, sf_dir, "words" if name == "bm25" else "plain", terms), retrieval.query_terms(q, terms), depth).withColumn("system", F.lit(name))
        out = run if out is None else out.unionByName(run)
    return Scratch(spark, "runs").save(out, "runs")  # depth rows a query and system, used more than once


def _targets(spark, sf_dir):
    """(qid, doc_id): documents that hold a passage whole."""
    return Scratch(spark, "targets").save(retrieval.phrase_matches(docs(spark, sf_dir), asked(spark, sf_dir)).select("qid", "doc_id"), "targets")


_PLAIN = f"""
p_words as (select doc_id, unnest({sql_plain('text')}) as term from documents),
p_postings as (select doc_id, term, count(*) as tf from p_words group by 1, 2),
p_terms as (select term, count(*) as df from p_postings group by 1),
p_query as (select qid, term, count(*) as qtf from (select item_id as qid, unnest({sql_plain('text')}) as term from benchmark) group by 1, 2),
plain as (select qid, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) as score
  from p_query join p_postings using (term) join p_terms using (term) join lengths using (doc_id) cross join stats group by 1, 2)
"""
_RUNS = f"""{SQL_BM25}, {_PLAIN},
runs as (select 'bm25' as system, * from ({sql_top('bm25', 20)}) union all select 'plain', * from ({sql_top('plain', 20)})),
targets as (
  select qid, doc_id from (select doc_id, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as t from documents)
  join (select item_id as qid, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as p from benchmark) on contains(t, p))
"""


@query(f"""with {_RUNS}, f as (select qid, doc_id, round(sum(case system when 'bm25' then 1.0 else 0.5 end / (60 + rank)), 9) as score from runs group by 1, 2)
select qid, doc_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from f) where rank <= 100""")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(_runs(spark, sf_dir), {"bm25": 1.0, "plain": 0.5})


@query(f"""with {_RUNS}, s as (select *, min(score) over w as lo, max(score) over w as hi from runs window w as (partition by system, qid)),
f as (select qid, doc_id, round(sum(case when hi > lo then (score - lo) / (hi - lo) else 0 end), 9) as score from s group by 1, 2)
select qid, doc_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from f) where rank <= 100""")
def combsum_fusion(spark, sf_dir):
    return fusion.comb_sum(_runs(spark, sf_dir), {"bm25": 1.0, "plain": 1.0})


@query(f"""with {_RUNS}, v as (select unnest([0.0, 0.5, 1.0, 2.0]::double[]) as v), grid as (select a.v as bm25, b.v as plain from v a, v b where a.v + b.v > 0),
piv as (select qid, doc_id, coalesce(sum(1.0 / (60 + rank)) filter (system = 'bm25'), 0) as rb, coalesce(sum(1.0 / (60 + rank)) filter (system = 'plain'), 0) as rp from runs group by 1, 2),
sc as (select bm25, plain, qid, doc_id, round(bm25 * rb + plain * rp, 9) as score from piv cross join grid),
own as (select bm25, plain, qid, max(score) as own from sc semi join targets using (qid, doc_id) group by 1, 2, 3 having max(score) > 0),
rk as (select bm25, plain, qid, count(*) as rank from sc join own using (bm25, plain, qid) where score >= own group by 1, 2, 3),
every as (select * from (select distinct qid from targets) cross join grid)
select printf('%.1f/%.1f', bm25, plain) as g, bm25, plain, round(avg(case when rank <= 10 then 1.0 / rank else 0 end), 6) as mrr,
  abs(bm25 - 1) + abs(plain - 1) as from_uniform from every left join rk using (bm25, plain, qid) group by all""")
def rrf_weight_grid(spark, sf_dir):
    out = fusion.tune_weights(_runs(spark, sf_dir), _targets(spark, sf_dir), ["bm25", "plain"])
    return out.withColumn("mrr", F.round("mrr", 6))


_RANKS = f"""{_RUNS}, cl as (select doc_id, min(doc_id) over (partition by md5(text)) as cluster from documents),
f as (select system, qid, cluster, min(rank) as r from runs join cl using (doc_id) group by 1, 2, 3),
pl as (select *, row_number() over (partition by system, qid order by r) as rank from f),
best as (select system, qid, min(rank) as rank from pl semi join (select qid, cluster from targets join cl using (doc_id)) t using (qid, cluster) group by 1, 2),
ranks as (select system, qid, rank from (select distinct system from runs) cross join (select distinct qid from targets) left join best using (system, qid))
"""


def _ranks(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", F.md5("text").alias("h"))
    groups = keyed.join(keyed.groupBy("h").agg(F.min("doc_id").alias("cluster")), "h").select("doc_id", "cluster")
    return E.target_ranks(_runs(spark, sf_dir), _targets(spark, sf_dir), groups)


@query(f"""with {_RANKS} select system, count(*) as n, round(avg(case when rank <= 10 then 1.0 / rank else 0 end), 6) as mrr10, round(avg(case when rank <= 1 then 1.0 else 0 end), 6) as s1,
  round(avg(case when rank <= 10 then 1.0 else 0 end), 6) as s10, round(avg(case when rank <= 100 then 1.0 else 0 end), 6) as r100,
  round(avg(coalesce(1.0 / rank, 0)), 6) as map, round(avg(case when rank <= 10 then 1.0 / log2(rank + 1) else 0 end), 6) as ndcg10 from ranks group by 1""")
def known_item_metrics(spark, sf_dir):
    return E.known_item_metrics(_ranks(spark, sf_dir), ["system"])


_HITS = f"""{_RUNS}, n as (select qid, count(*) as n_relevant from targets group by 1),
h as (select r.qid, r.rank, (t.doc_id is not null)::int as hit from runs r left join targets t on t.qid = r.qid and t.doc_id = r.doc_id where system = 'bm25'),
down as (select qid, rank, hit, n_relevant, sum(hit) over (partition by qid order by rank) / rank as prec, sum(hit) over (partition by qid order by rank) / n_relevant as rec from h join n using (qid))
"""


def _bm25(spark, sf_dir):
    return _runs(spark, sf_dir).where("system = 'bm25'")


@query(f"""with {_HITS} select qid, round(sum(hit * prec) / n_relevant, 6) as ap, round(coalesce(sum(hit) filter (rank <= 10), 0) / 10, 6) as p10,
  round(coalesce(sum(hit) filter (rank <= n_relevant), 0) / n_relevant, 6) as r_precision,
  round(coalesce(sum(hit / log2(rank + 1)) filter (rank <= 10), 0) / list_sum(list_transform(generate_series(1, least(n_relevant, 10)), lambda i: 1.0 / log2(i + 1))), 6) as ndcg10
from down group by qid, n_relevant""")
def ndcg_map(spark, sf_dir):
    return E.graded_metrics(_bm25(spark, sf_dir), _targets(spark, sf_dir))


@query(f"""with {_HITS}, l as (select qid, level, coalesce(max(prec) filter (round(rec * 10, 9) >= level), 0) as p from down cross join (select unnest(generate_series(0, 10)) as level) group by 1, 2)
select level::int as level, round(avg(p), 6) as precision from l group by 1""")
def pr_curve_11pt(spark, sf_dir):
    return E.precision_at_recall(_bm25(spark, sf_dir), _targets(spark, sf_dir))


@query("""with p as (select p_type as name, round(avg(p_size) / 2000, 6) as p from part group by 1), r as (select *, row_number() over (order by p, name) as i, count(*) over () as m from p)
select name, p, round(max(least(1, (m - i + 1) * p)) over (order by i), 6) as p_holm from r""")
def holm_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.round(F.avg("p_size") / 2000, 6).alias("p"))
    return E.holm(tests).withColumn("p_holm", F.round("p_holm", 6))


@query("""with s as (select n_name as name, round(avg(c_acctbal), 2) as x, count(*) as y from customer join nation on c_nationkey = n_nationkey group by 1)
select round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt((count(*) filter (a.x <> b.x))::double * count(*) filter (a.y <> b.y)), 6) as tau from s a join s b on a.name < b.name""")
def kendall_tau_systems(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    s = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.round(F.avg("c_acctbal"), 2).alias("x"), F.count("*").alias("y"))
    return E.kendall_tau(s)


@query("""with r as (select case when quality = 1 then 'good' else 'bad' end as truth, case when contains(text, '!!') or contains(text, ' | ') then 'bad' else 'good' end as said from labels join documents using (doc_id)),
l as (select truth as label, count(*) as support, count(*) filter (truth = said) as tp from r group by 1), s as (select said as label, count(*) as said from r group by 1)
select label, round(coalesce(tp / said, 0), 6) as precision, round(tp / support, 6) as recall,
  round(case when tp > 0 then 2 * (tp / said) * (tp / support) / (tp / said + tp / support) else 0 end, 6) as f1, support from l left join s using (label)""")
def confusion_prf(spark, sf_dir):
    said = F.when(F.col("text").contains("!!") | F.col("text").contains(" | "), "bad").otherwise("good")
    rows = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), said.alias("said"))
    return E.confusion(rows, "truth", "said")


@query(f"""with {_RANKS}, d as (select qid, max(coalesce(1.0 / rank, 0)) filter (system = 'bm25') - max(coalesce(1.0 / rank, 0)) filter (system = 'plain') as d from ranks group by 1)
select round(avg(d), 6) as mean, round(case when stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 6) as t, count(*) as n from d""")
def paired_t_test(spark, sf_dir):
    return E.paired_t(_diffs(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), "n")


def _diffs(spark, sf_dir):
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    of = lambda s: F.max(F.when(F.col("system") == s, rr))
    return _ranks(spark, sf_dir).groupBy(F.col("qid").alias("key")).agg((of("bm25") - of("plain")).alias("d"))


@query()
def randomisation_test(spark, sf_dir):
    return E.sign_flip_test(_diffs(spark, sf_dir), 500)


@query()
def bootstrap_interval(spark, sf_dir):
    return E.bootstrap_interval(_diffs(spark, sf_dir).withColumnRenamed("d", "v"), 200)


@query()
def team_draft_interleaving(spark, sf_dir):
    return fusion.interleave(_runs(spark, sf_dir), "bm25", "plain")


@query(f"""with {_RUNS}, s as (select *, min(score) over w as lo, max(score) over w as hi from runs window w as (partition by system, qid)),
c as (select qid, doc_id, min(rank) filter (system = 'bm25') as r1, min(rank) filter (system = 'plain') as r2,
  coalesce(max(case when hi > lo then (score - lo) / (hi - lo) else 1 end) filter (system = 'bm25'), 0) as s1 from s group by 1, 2)
select qid, doc_id, round(ln(coalesce(r1, 101)), 6) as bm25_log_rank, round(coalesce(1.0 / (60 + r2), 0), 6) as plain_rr, round(s1, 6) as bm25_scaled from c""")
def ltr_features(spark, sf_dir):
    f = fusion.list_features(_runs(spark, sf_dir), ["bm25", "plain"])
    return f.select("qid", "doc_id", *[F.round(c, 6).alias(c) for c in ("bm25_log_rank", "plain_rr", "bm25_scaled")])


@query()
def ltr_reranked(spark, sf_dir):
    """Candidates of two lists ranked by a logistic model learnt from where the passages are."""
    systems = ["bm25", "plain"]
    features = fusion.list_features(_runs(spark, sf_dir), systems).join(_targets(spark, sf_dir).withColumn("label", F.lit(1)), ["qid", "doc_id"], "left").na.fill({"label": 0})
    columns = [f"{s}_{x}" for s in systems for x in ("log_rank", "rr", "scaled")]
    return fusion.rank_with(fusion.fit_ranker(features, "label", columns), features, columns, 10)


def _sql_grams(x: str) -> str:
    padded = "'#' || w || '#'"
    return f"flatten(list_transform({sql_plain(x)}, lambda w: case when length(w) < 2 then [{padded}] else list_transform(generate_series(1, length(w)), lambda i: ({padded})[i:i + 2]) end))"


@query(f"with {SQL_BM25.replace(sql_tokens('text'), _sql_grams('text'))} {sql_top('bm25', 10)}")
def char_gram_run(spark, sf_dir):
    """BM25 over character trigrams inside plain words."""
    terms = char_ngrams_padded(plain_tokens(F.col("text")), 3)
    return retrieval.bm25_top(document_index(spark, sf_dir, "trigrams", terms), retrieval.query_terms(asked(spark, sf_dir), terms), 10)


@query(f"""with {_RUNS}, r as (select qid, doc_id, rank, score, length(text)::double as new, rank <= 5 as head from runs join documents using (doc_id) where system = 'bm25'),
m as (select qid, doc_id, rank, case when head then round(0.6 * case when max(new) over w > min(new) over w then (new - min(new) over w) / (max(new) over w - min(new) over w) else 0 end
  + 0.4 * case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end, 9) end as key from r window w as (partition by qid, head))
select qid, doc_id, (row_number() over (partition by qid order by key desc nulls last, rank, doc_id))::int as rank from m""")
def reranked(spark, sf_dir):
    """The first five of each ranking ordered anew by text length and score."""
    scores = docs(spark, sf_dir).select("doc_id", F.length("text").cast("double").alias("new"))
    run = _bm25(spark, sf_dir)
    return fusion.rerank(run, run.select("qid", "doc_id").join(scores, "doc_id"), 5, 0.6)
