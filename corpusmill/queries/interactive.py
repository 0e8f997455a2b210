"""Expansion, mixtures, boosts, kinds of queries, relations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import plain_tokens, tokens
from corpusmill.operators import interactive as I
from corpusmill.operators import retrieval as R
from corpusmill.operators import studies
from corpusmill.queries.common import SQL_BM25, SQL_INDEX, Family, asked, docs, document_index, sql_clean, sql_plain, sql_tokens, sql_top, table
from corpusmill.queries.ranking import _RUNS, _runs, _targets

FAMILY = Family()
query = FAMILY.query

_PAIRS = {"the": "das", "of": "der", "and": "und", "is": "ist"}
_WEIGHTED = """run as (select qid, doc_id, sum(w * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) as score
  from weighted join postings using (term) join terms using (term) join lengths using (doc_id) cross join stats group by 1, 2)"""


@query(f"""with {SQL_INDEX}, s(term, other) as (values {', '.join(f"('{a}', '{b}')" for a, b in _PAIRS.items())}),
m as (select qid, other as term, 0.3 * sum(qtf) as w from query join s using (term) group by 1, 2),
weighted as (select qid, term, qtf::double as w from query union all select m.* from m anti join query using (qid, term)), {_WEIGHTED} {sql_top('run', 10)}""")
def expanded_top10(spark, sf_dir):
    """Queries with synonyms at three tenths of the weight."""
    synonyms = spark.createDataFrame(list(_PAIRS.items()), "term string, other string")
    index = document_index(spark, sf_dir)
    return R.bm25_top(index, I.expanded(R.query_terms(asked(spark, sf_dir)), synonyms), 10)


@query(f"""with {SQL_INDEX}, r as (select item_id as qid, {sql_tokens('text')} as t, 3.0 as p from benchmark union all select item_id, ({sql_tokens('text')})[1:5], 1.0 from benchmark),
weighted as (select qid, term, sum(share) as w from (select qid, p / sum(p) over (partition by qid) as share, t from r) x, unnest(t) u(term) group by 1, 2), {_WEIGHTED} {sql_top('run', 10)}""")
def reading_mixture_top10(spark, sf_dir):
    """Two readings of each query, three parts to one."""
    q = asked(spark, sf_dir)
    short = q.select("qid", F.array_join(F.slice(tokens(F.col("text")), 1, 5), " ").alias("text"), F.lit(1.0).alias("p"))
    index = document_index(spark, sf_dir)
    return R.bm25_top(index, I.reading_mixture(q.withColumn("p", F.lit(3.0)).unionByName(short)), 10)


@query(f"""with {SQL_INDEX}, k as (select qid, term, df from query join terms using (term)), s as (select qid, count(*) as terms, sum(df)::bigint as postings from k group by 1),
m as (select qid, count(distinct doc_id) as documents from k join postings using (term) group by 1) select * from s join m using (qid)""")
def evaluation_costs(spark, sf_dir):
    """Postings and documents that a query touches."""
    return I.evaluation_costs(document_index(spark, sf_dir), R.query_terms(asked(spark, sf_dir)))


@query(f"""with {SQL_BM25}, run0 as ({sql_top('bm25', 20)}), top as (select qid, max(score) as m from run0 group by 1),
facts as (select doc_id, source as maker, array_to_string(({sql_plain('text')})[1:3], ' ') as title, lang as feels, doc_id % 100 / 100.0 as standing from documents),
wishes as (select item_id as qid, array_to_string({sql_plain('text')}, ' ') as plain, case when item_id % 4 = 0 then 'src' || (item_id % 20) end as artist, case when item_id % 2 = 0 then 'en' end as mood from benchmark),
w as (select *, coalesce(m, 1.0 / 61) as mm from wishes left join top using (qid)), e as (select qid, doc_id, 0.0 as score from w join facts f on f.maker = w.artist),
pool as (select qid, doc_id, score from run0 union all select e.* from e anti join run0 using (qid, doc_id)),
run as (select qid, doc_id, score + mm * (case when maker = artist then 1.0 else 0 end
  + case when len(string_split(title, ' ')) >= 2 and title = plain then 1.0 when len(string_split(title, ' ')) >= 3 and contains(' ' || plain || ' ', ' ' || title || ' ') then 0.5 else 0 end
  + case when feels = mood then 0.25 else 0 end + 0.01 * standing) as score from pool join facts using (doc_id) join w using (qid)) {sql_top('run', 10)}""")
def boosted_top10(spark, sf_dir):
    """BM25 with additions for a source that was asked for, titles, language and standing."""
    d, q = table(spark, sf_dir, "documents"), asked(spark, sf_dir)
    run = R.bm25_top(document_index(spark, sf_dir), R.query_terms(q), 20)
    facts = d.select(
        "doc_id", F.col("source").alias("artist"), F.array_join(F.slice(plain_tokens(F.col("text")), 1, 3), " ").alias("title"), F.col("lang").alias("mood"), (F.col("doc_id") % 100 / 100.0).alias("standing")
    )
    wishes = q.select(
        "qid", F.array_join(plain_tokens(F.col("text")), " ").alias("plain"), F.when(F.col("qid") % 4 == 0, F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))).alias("artist"), F.when(F.col("qid") % 2 == 0, "en").alias("mood")
    )
    return I.boosted(run, facts, wishes, 10)


_FEATURES = f"""v as (select distinct unnest({sql_tokens('text')}) as w from documents), pv as (select distinct strip_accents(w) as p from v),
q as (select item_id as qid, unnest(case when len({sql_tokens('text')}) > 0 then {sql_tokens('text')} else [''] end) as w from benchmark),
features as (select qid, round(avg(case when w <> strip_accents(w) then 1.0 else 0 end), 6) as marked, round(avg(case when w not in (select w from v) then 1.0 else 0 end), 6) as oov_marked,
  round(avg(case when strip_accents(w) not in (select p from pv) then 1.0 else 0 end), 6) as oov_plain, round(least(count(*), 40) / 40.0, 6) as length from q group by 1)"""


def _vocabulary(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("word")).distinct()


@query(f"with {_FEATURES} select * from features")
def query_features(spark, sf_dir):
    return I.query_features(asked(spark, sf_dir), _vocabulary(spark, sf_dir))


@query()
def query_kinds(spark, sf_dir):
    """Kinds of queries (passages as they are, plain, and cut) by models fitted without their fold."""
    q = asked(spark, sf_dir)
    plain = q.select((F.col("qid") + 1000).alias("qid"), F.array_join(plain_tokens(F.col("text")), " ").alias("text"), F.lit("plain").alias("kind"), F.col("qid").alias("cluster"))
    cut = q.select((F.col("qid") + 2000).alias("qid"), F.array_join(F.slice(tokens(F.col("text")), 1, 4), " ").alias("text"), F.lit("cut").alias("kind"), F.col("qid").alias("cluster"))
    whole = q.select("qid", "text", F.lit("whole").alias("kind"), F.col("qid").alias("cluster"))
    return I.classify_kinds(whole.unionByName(plain).unionByName(cut), _vocabulary(spark, sf_dir), folds=3)




@query(f"""with l as (select doc_id, {sql_clean('line')} as line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
a as (select doc_id, 'is' as relation, regexp_extract_all(line, '(^| )([a-z]+) is (([a-z]+ ){{0,2}}[a-z]+)', 2) as s, regexp_extract_all(line, '(^| )([a-z]+) is (([a-z]+ ){{0,2}}[a-z]+)', 3) as o from l
  union all select doc_id, 'of', regexp_extract_all(line, '(^| )([a-z]+) of ([a-z]+)', 2), regexp_extract_all(line, '(^| )([a-z]+) of ([a-z]+)', 3) from l)
select distinct doc_id, relation, unnest(s) as subject, unnest(o) as object from a""")
def relations_found(spark, sf_dir):
    """What lines say by two patterns."""
    return I.relations(docs(spark, sf_dir), {"is": "(?:^| )([a-z]+) is ((?:[a-z]+ ){0,2}[a-z]+)", "of": "(?:^| )([a-z]+) of ([a-z]+)"})


@query(f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents), t as (select doc_id, line_no, {sql_tokens('line')} as w from l),
a as (select *, unnest(w) as trigger, generate_subscripts(w, 1) - 1 as p from t)
select doc_id, line_no::int as line_no, p::int as place_no, trigger, case trigger when 'was' then 'state' else 'act' end as type,
  list_filter(w[1:p], lambda x: x in ('the', 'that', 'der'))[-1] as agent, list_filter(w[p + 2:p + 4], lambda x: x in ('the', 'that', 'der'))[1] as patient,
  list_filter(w, lambda x: x in ('in', 'on'))[1] as place, p > 0 and len(list_intersect(w[greatest(p - 1, 1):p], ['not', 'and'])) > 0 as negated
from a where trigger in ('was', 'by', 'from')""")
def events_found(spark, sf_dir):
    """Trigger words with the words around them."""
    return I.events(docs(spark, sf_dir), {"was": "state", "by": "act", "from": "act"}, ["the", "that", "der"], ["in", "on"], ["not", "and"]).withColumnRenamed("at", "place_no")


@query("""with t as (select event_id, case when event_type = 'signup' then 'greet' else 'find' end as intent, case when user_id % 9 = 0 then null else value / 200 end as top, case when event_id % 3 > 0 then value / 210 end as second, user_id % 3 as n_slots from events)
select event_id, case when intent = 'greet' then 'greet' when top is null then 'nothing' when top < 0.35 then case when n_slots = 0 then 'ask' else 'confirm' end when top - coalesce(second, 0) < 0.1 then 'choose' else 'answer' end as step from t""")
def next_steps(spark, sf_dir):
    """What a dialogue does next."""
    e = table(spark, sf_dir, "events")
    turns = e.select(
        "event_id", F.when(F.col("event_type") == "signup", "greet").otherwise("find").alias("intent"), F.when(F.col("user_id") % 9 != 0, F.col("value") / 200).alias("top"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") / 210).alias("second"), (F.col("user_id") % 3).alias("n_slots"),
    )
    return I.next_steps(turns).select("event_id", "step")


@query(f"""with {SQL_INDEX}, targets as (select qid, doc_id from (select doc_id, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as t from documents)
  join (select item_id as qid, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' as p from benchmark) on contains(t, p)),
g as (select * from (values (0.5), (0.9), (1.5)) k(k1), (values (0.2), (0.4), (0.75)) l(b)),
s as (select k1, b, qid, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) as s
  from query join postings using (term) join terms using (term) join lengths using (doc_id) cross join stats cross join g group by 1, 2, 3, 4),
r as (select *, row_number() over (partition by k1, b, qid order by s desc, doc_id) as r from s), f as (select k1, b, qid, min(r) as r from r semi join targets using (qid, doc_id) group by 1, 2, 3)
select k1::double as k1, b::double as b, round(avg(case when r <= 10 then 1.0 / r else 0 end), 6) as mrr10 from (select distinct qid, k1, b from targets cross join g) left join f using (k1, b, qid) group by 1, 2""")
def bm25_parameter_grid(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return I.parameter_grid(index, R.query_terms(asked(spark, sf_dir)), _targets(spark, sf_dir), (0.5, 0.9, 1.5), (0.2, 0.4, 0.75))


@query(f"""with {_RUNS}, a as (select * from runs where system = 'bm25'), n as (select qid, doc_id, score as new from runs where system = 'plain'),
m as (select qid, case when max(score) filter (rank = 1) > 0 then (max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0)) / max(score) filter (rank = 1) else 0 end as margin from a group by 1),
u as (select qid from m where margin < 0.2), b as (select a.qid, a.doc_id, rank, score, coalesce(new, 0) as new, rank <= 5 as head from a left join n using (qid, doc_id) semi join u using (qid)),
s as (select *, min(new) over w as nl, max(new) over w as nh from b window w as (partition by qid, head)),
k as (select *, case when head then round(case when nh > nl then (new - nl) / (nh - nl) else 0 end, 9) end as key from s)
select qid, doc_id, (row_number() over (partition by qid order by key desc nulls last, rank, doc_id))::int as rank from k
union all select qid, doc_id, rank::int from a anti join u using (qid)""")
def selectively_reranked(spark, sf_dir):
    """The first five of unsure lists ordered anew."""
    runs = _runs(spark, sf_dir)
    own = runs.where("system = 'bm25'").select("system", "qid", "doc_id", "rank", "score")
    unsure = studies.margins(own).where("margin < 0.2")
    new = runs.where("system = 'plain'").select("qid", "doc_id", F.col("score").alias("new"))
    return I.selectively_reranked(own.drop("system"), new, unsure, 5)


@query(f"""with {_FEATURES}, n as (select distinct lower(p_name) as name from part), b as (select item_id as qid, {sql_clean('text')} as cleaned, strip_accents({sql_clean('text')}) as plain from benchmark),
m as (select qid, cleaned, plain, list_filter(list_transform(string_split(plain, ' '), lambda w: case w when 'the' then 'calm' when 'und' then 'loud' end), lambda x: x is not null)[1] as mood from b),
h as (select m.*, (select name from n where contains(' ' || plain || ' ', ' ' || name || ' ') order by length(name) desc, name limit 1) as artist from m)
select h.qid, cleaned, plain, null::varchar as quoted, mood, artist, marked, oov_marked, oov_plain, length from h join features using (qid)""")
def queries_analysed(spark, sf_dir):
    """All that is known of a query in one row."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"))
    return I.analysed(asked(spark, sf_dir), _vocabulary(spark, sf_dir), {"the": "calm", "und": "loud"}, names)
