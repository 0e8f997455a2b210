"""Studies of runs: benchmark passages as queries of three kinds, documents that hold them as targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import studies as S
from corpusmill.plans.durable import Scratch
from corpusmill.queries.common import Family, asked, docs, sql_plain, table
from corpusmill.queries.ranking import _RUNS, _runs, _targets

FAMILY = Family()
query = FAMILY.query


def _kinds(spark, sf_dir):
    q = asked(spark, sf_dir)
    return q.select("qid", F.concat(F.lit("k"), (F.col("qid") % 3).cast("string")).alias("kind"), F.floor(F.col("qid") / 2).alias("cluster"))


def _groups(spark, sf_dir):
    """Texts are groups of their own: every document is its own cluster here."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("cluster"))


def _measured(spark, sf_dir):
    """(runs, targets, ranks, values)"""
    runs, targets = _runs(spark, sf_dir), _targets(spark, sf_dir)
    ranks = Scratch(spark, "ranks").save(E.target_ranks(runs, targets, _groups(spark, sf_dir)), "ranks")
    return runs, targets, ranks, S.reciprocal_ranks(ranks)


_VALUES = f"""{_RUNS}, every as (select system, qid from (select distinct system from runs), (select distinct qid from targets)),
best as (select system, qid, min(rank) as rank from runs semi join targets using (qid, doc_id) group by 1, 2),
ranks as (select system, qid, rank from every left join best using (system, qid)),
vals as (select system, qid, case when rank <= 10 then 1.0 / rank else 0 end as v from ranks),
kinds as (select item_id as qid, 'k' || (item_id % 3) as kind from benchmark),
scores as (select system, kind, avg(v) as v from vals join kinds using (qid) group by 1, 2)"""


@query(f"with {_VALUES} select system, kind, round(v, 6) as v from scores")
def scores_by_kind(spark, sf_dir):
    *_, values = _measured(spark, sf_dir)
    return S.kind_scores(values, _kinds(spark, sf_dir)).withColumn("v", F.round("v", 6))


_TAU = "round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(count(*) filter (a.x <> b.x)::double * count(*) filter (a.y <> b.y)), 0), 6) as tau"


@query(f"""with {_VALUES}, t as (select system, sum(v) as s, count(*) as k from scores group by 1),
r as (select kind, system, v as x, (s - v) / (k - 1) as y from scores join t using (system))
select a.kind, {_TAU} from r a join r b on a.kind = b.kind and a.system < b.system group by 1""")
def kinds_left_out(spark, sf_dir):
    """Agreement of the order of systems on one kind of queries with that on the others."""
    *_, values = _measured(spark, sf_dir)
    return S.leave_one_out_agreement(S.kind_scores(values, _kinds(spark, sf_dir)))


@query(f"""with {_VALUES}, r as (select p.kind as kind_a, q.kind as kind_b, p.system, p.v as x, q.v as y from scores p join scores q on p.system = q.system and p.kind < q.kind)
select a.kind_a, a.kind_b, {_TAU} from r a join r b on a.kind_a = b.kind_a and a.kind_b = b.kind_b and a.system < b.system group by 1, 2""")
def kinds_agree(spark, sf_dir):
    *_, values = _measured(spark, sf_dir)
    return S.kind_agreement(S.kind_scores(values, _kinds(spark, sf_dir)))


@query(f"""with {_VALUES}, b as (select qid, max(v) filter (system = 'bm25') as a, max(v) filter (system = 'plain') as b from vals group by 1)
select count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(b - a), 6) as delta, count(*) filter (b > a) as wins, count(*) filter (b < a) as losses from b""")
def wins_and_losses(spark, sf_dir):
    *_, values = _measured(spark, sf_dir)
    out = S.paired_summary(values, "bm25", "plain")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")), "wins", "losses")


@query()
def compared_systems(spark, sf_dir):
    """A family of comparisons with corrected tests, and how many pairs of systems the test can tell apart."""
    *_, values = _measured(spark, sf_dir)
    family = S.comparison_family(values, [("bm25", "plain")], 200)
    return family.crossJoin(S.discriminative_power(values, permutations=100))  # one row


@query()
def macro_tests(spark, sf_dir):
    """Cluster-wise test and interval of the mean over kinds."""
    *_, values = _measured(spark, sf_dir)
    kinds = _kinds(spark, sf_dir)
    sign = F.when(F.col("system") == "plain", F.col("v")).otherwise(-F.col("v"))
    diffs = values.groupBy("qid").agg(F.sum(sign).alias("d"))
    interval = S.macro_bootstrap(values.where("system = 'bm25'").select("qid", "v"), kinds, 100)
    return S.macro_flip_test(diffs, kinds, 200).crossJoin(interval)  # one row each


@query()
def score_table(spark, sf_dir):
    *_, values = _measured(spark, sf_dir)
    return S.score_table(values, _kinds(spark, sf_dir), "bm25", 100)


@query()
def leading_systems(spark, sf_dir):
    """How often each system leads under random weights of the kinds."""
    *_, values = _measured(spark, sf_dir)
    return S.mixture_sensitivity(S.kind_scores(values, _kinds(spark, sf_dir)), 100)


@query(f"""with {_VALUES}, f as (select unnest([0.25, 0.5]) as fraction, unnest([3, 3]) as reps union all select 1.0, 1), g as (select fraction, unnest(generate_series(0, reps - 1)) as rep from f),
w as (select distinct qid, doc_id, true as wanted from targets),
c as (select runs.*, fraction, rep, coalesce(wanted, false) as wanted from runs left join w using (qid, doc_id) cross join g),
k as (select * from c where wanted or fraction >= 1 or ('0x' || substr(md5('1:' || rep || ':' || printf('%.2f', fraction) || ':' || doc_id), 1, 8))::bigint / 4294967295.0 < fraction),
p as (select system, qid, fraction, rep, wanted, row_number() over (partition by system, qid, fraction, rep order by rank) as place from k),
b as (select system, qid, fraction, rep, min(place) as place from p where wanted group by 1, 2, 3, 4)
select system, fraction::double as fraction, round(avg(case when place <= 10 then 1.0 / place else 0 end), 6) as mrr10 from (select * from every cross join g) left join b using (system, qid, fraction, rep) group by 1, 2""")
def smaller_catalogues(spark, sf_dir):
    """Scores among a quarter and a half of the documents, three draws each, and among all."""
    runs, targets, *_ = _measured(spark, sf_dir)
    return S.restricted_catalogue(runs, targets, _groups(spark, sf_dir), (0.25, 0.5, 1.0))


@query(f"""with {_VALUES}, h as (select doc_id, list_distinct({sql_plain('text')}) as held from documents), q as (select item_id as qid, {sql_plain('text')} as q from benchmark),
s as (select t.qid, len(q) as length, case when len(q) > 0 then len(list_filter(q, lambda w: list_contains(held, w))) / len(q) else 0 end as overlap from targets t join h using (doc_id) join q using (qid)),
b as (select qid, max(overlap) as overlap, max(length) as length from s group by 1)
select system, coalesce(rank > 10, true) as fail, count(*) as n, round(avg(overlap), 6) as overlap, round(avg(length), 6) as length from ranks join b using (qid) group by 1, 2""")
def failures_profiled(spark, sf_dir):
    _, targets, ranks, _ = _measured(spark, sf_dir)
    return S.failure_profile(ranks, asked(spark, sf_dir), targets, docs(spark, sf_dir))


@query(f"""with {_VALUES}, f as (select *, row_number() over (partition by system order by md5(qid::varchar), qid) as k from ranks where coalesce(rank > 1, true)),
three as (select system, qid, string_agg(doc_id::varchar, ',' order by rank) as first from runs where rank <= 3 group by 1, 2)
select system, qid, rank::int as rank, first from f left join three using (system, qid) where k <= 5""")
def failures_sampled(spark, sf_dir):
    """Five queries a system whose target isn't first, with what stands before."""
    runs, _, ranks, _ = _measured(spark, sf_dir)
    return S.failure_sample(ranks, runs, _groups(spark, sf_dir), 1, 5)


_MARGINS = """m as (select system, qid, max(score) filter (rank = 1) as top, max(score) filter (rank = 2) as second from runs group by 1, 2),
mar as (select system, qid, top, case when top > 0 then (top - coalesce(second, 0)) / top else 0 end as margin from m)"""


@query(f"with {_RUNS}, {_MARGINS} select system, qid, top, round(margin, 6) as margin from mar")
def list_margins(spark, sf_dir):
    return S.margins(_runs(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


@query(f"""with {_RUNS}, {_MARGINS}, t as (select quantile_cont(margin, 0.5) as theta from mar where system = 'bm25'),
p as (select qid, case when margin >= theta then 'bm25' else 'plain' end as system from mar, t where system = 'bm25'),
q as (select distinct qid from runs), r as (select q.qid, coalesce(p.system, 'plain') as system from q left join p using (qid))
select qid, doc_id, rank::int as rank, system from runs semi join r using (qid, system)""")
def routed_by_margin(spark, sf_dir):
    """The surer half of the queries from one system, the others from another."""
    return S.routed_by_margin(_runs(spark, sf_dir), "bm25", "plain", 0.5).select("qid", "doc_id", "rank", "system")


@query(f"""with {_RUNS}, s as (select *, min(score) over w as lo, max(score) over w as hi from runs window w as (partition by system, qid)),
b as (select qid, doc_id, coalesce(max(case when hi > lo then (score - lo) / (hi - lo) else 0 end) filter (system = 'bm25'), 0) as sa, coalesce(max(case when hi > lo then (score - lo) / (hi - lo) else 0 end) filter (system = 'plain'), 0) as sb from s group by 1, 2),
g as (select unnest(generate_series(0, 10)) / 10.0::double as alpha), x as (select alpha, qid, doc_id, round(alpha * sb + (1 - alpha) * sa, 9) as s from b cross join g),
o as (select alpha, qid, max(s) as own from x semi join targets using (qid, doc_id) group by 1, 2), r as (select alpha, qid, count(*) as rank from x join o using (alpha, qid) where s >= own group by 1, 2)
select alpha, round(avg(case when rank <= 10 then 1.0 / rank else 0 end), 6) as mrr10 from (select distinct qid, alpha from targets cross join g) left join r using (alpha, qid) group by 1""")
def convex_mixtures(spark, sf_dir):
    return S.convex_grid(_runs(spark, sf_dir), _targets(spark, sf_dir), "bm25", "plain")


@query()
def adaptive_weights(spark, sf_dir):
    """Fusion weights of each kind of query, kept only where cross-validation favours them."""
    save = lambda df: Scratch(spark, "adaptive").save(df, "rr")
    return S.adaptive_weights(_runs(spark, sf_dir), _targets(spark, sf_dir), _kinds(spark, sf_dir), ["bm25", "plain"], save=save)


@query(f"""with d as (select doc_id, ' ' || array_to_string({sql_plain('text')}, ' ') || ' ' as t from documents), q as (select item_id as qid, {sql_plain('text')} as w from benchmark),
c as (select qid, n, ' ' || array_to_string(w[1:n], ' ') || ' ' as p from q, (values (1), (2), (3), (5), (8)) k(n) where len(w) >= n)
select qid, n::int as length, count(doc_id) as n from c left join d on contains(t, p) group by 1, 2""")
def openings_held(spark, sf_dir):
    """How many texts hold the first words of a passage, by their number."""
    return S.opening_candidates(asked(spark, sf_dir), docs(spark, sf_dir), (1, 2, 3, 5, 8))


@query(f"""with {_RUNS}, h as (select doc_id, list_distinct({sql_plain('text')}) as held from documents), q as (select item_id as qid, {sql_plain('text')} as q from benchmark),
o as (select qid, (doc_id + 1) % ((select max(doc_id) from documents) + 1) as doc_id from targets),
s as (select qid, round(max(len(list_filter(q, lambda w: list_contains(held, w))) / len(q)), 6) as overlap from targets join h using (doc_id) join q using (qid) group by 1),
z as (select qid, round(max(len(list_filter(q, lambda w: list_contains(held, w))) / len(q)), 6) as other from o join h using (doc_id) join q using (qid) group by 1)
select qid, overlap, other from s left join z using (qid)""")
def words_shared(spark, sf_dir):
    """Share of a query's words in its target and in another text."""
    return S.overlap_with_targets(asked(spark, sf_dir), _targets(spark, sf_dir), docs(spark, sf_dir))


@query("""with k as (select item_id as qid, (['N0','N20','E10','W0','Q3u','Q4s','Q5g','Q2'])[item_id % 8 + 1] as kind from benchmark)
select qid, kind, case when kind in ('N0', 'W0') then 'Q1' when kind in ('N20', 'E10', 'Q3u') then 'Q3' when kind = 'Q4s' then 'Q4' when kind = 'Q5g' then 'Q5' else kind end as weights_of from k""")
def oracle_kinds(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("N0", "N20", "E10", "W0", "Q3u", "Q4s", "Q5g", "Q2")])
    kinds = asked(spark, sf_dir).select("qid", F.element_at(names, (F.col("qid") % 8 + 1).cast("int")).alias("kind"))
    return kinds.withColumn("weights_of", S.oracle_kind(F.col("kind")))
