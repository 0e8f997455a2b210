"""Logs over ``events`` and dialogue over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import logs
from corpusmill.queries.common import Family, table

FAMILY = Family()
query = FAMILY.query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_LOG = """log as (select user_id as session, ts, repeat('ab', (event_id % 4)::int + 1) as query, event_id from events)"""


@query(f"""with {_LOG}, n as (select *, lead(query) over w as q2, lead(ts) over w as t2 from log window w as (partition by session order by ts, query))
select event_id from n where not coalesce(epoch(t2) - epoch(ts) < 3600 and q2 <> query and starts_with(q2, query), false)""")
def prefix_cleanup(spark, sf_dir):
    """Queries that the next one of the session goes on from are dropped."""
    text = F.repeat(F.lit("ab"), (F.col("event_id") % 4 + 1).cast("int"))
    log = _events(spark, sf_dir).select(F.col("user_id").alias("session"), "ts", text.alias("query"), "event_id")
    return logs.drop_typing(log, 3600).select("event_id")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) as n_events from s group by user_id, sid""")
def session_stats(spark, sf_dir):
    return logs.sessions(_events(spark, sf_dir), "user_id")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def hourly_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select strftime(ts, '%H:00') as hour, count(*) as n from events group by 1")
def by_hour_of_day(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "HH:00").alias("hour")).agg(F.count("*").alias("n"))


_RANKED = "e as (select *, (props->>'k')::int % 10 + 1 as rank from events)"


def _rank():
    return F.get_json_object("props", "$.k").cast("int") % 10 + 1


@query(f"""with {_RANKED}, n as (select count(*) filter (event_type = 'view') as shown from e) select rank, count(*) filter (event_type = 'click') as clicks,
  round(count(*) filter (event_type = 'click') / any_value(shown), 6) as ctr from e cross join n group by 1""")
def ctr_by_rank(spark, sf_dir):
    e = _events(spark, sf_dir)
    shown = e.agg(F.count_if(F.col("event_type") == "view").alias("shown"))
    counts = e.groupBy(_rank().alias("rank")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"))
    return counts.crossJoin(shown).select("rank", "clicks", F.round(F.col("clicks") / F.col("shown"), 6).alias("ctr"))


@query("""with v as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events)
select min(value) filter (i = floor(0.5 * n)) as p50, min(value) filter (i = floor(0.95 * n)) as p95 from v""")
def log_percentiles(spark, sf_dir):
    return logs.quantiles_by_rank(_events(spark, sf_dir), "value", {"p50": 0.5, "p95": 0.95})


@query(f"""with {_RANKED}, f as (select user_id, min(rank) as first_rank from e where event_type = 'click' group by 1), n as (select count(distinct user_id) as users from e)
select count(*) as clicked, any_value(users) as users, round(sum(1.0 / first_rank) / any_value(users), 6) as click_mrr, round(1 - count(*) / any_value(users), 6) as abandoned from f cross join n""")
def click_metrics(spark, sf_dir):
    e = _events(spark, sf_dir)
    first = e.where("event_type = 'click'").groupBy("user_id").agg(F.min(_rank()).alias("r"))
    users = e.agg(F.count_distinct("user_id").alias("users"))
    got = first.agg(F.count("*").alias("clicked"), F.sum(1.0 / F.col("r")).alias("s")).crossJoin(users)
    return got.select("clicked", "users", F.round(F.col("s") / F.col("users"), 6).alias("click_mrr"), F.round(1 - F.col("clicked") / F.col("users"), 6).alias("abandoned"))


@query("""with p as (select distinct user_id, (props->>'k')::int as item from events where event_type = 'purchase'),
n as (select a.item as a, b.item as b, count(*) as n from p a join p b on a.user_id = b.user_id and a.item <> b.item group by 1, 2) select a, b, n from n where n >= 8""")
def co_click_items(spark, sf_dir):
    pairs = _events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"))
    return logs.co_used(pairs, "user_id", "item", 8)


@query(f"""with {_RANKED}, t as (select user_id, date_trunc('day', ts) as day, count(*) filter (event_type = 'click' and rank % 2 = 0) as a, count(*) filter (event_type = 'click' and rank % 2 = 1) as b from e group by 1, 2)
select case when a + b = 0 then 'no click' when a > b then 'A' when b > a then 'B' else 'tie' end as winner, count(*) as n from t group by 1""")
def team_wins(spark, sf_dir):
    click = lambda odd: F.count_if((F.col("event_type") == "click") & (_rank() % 2 == odd))
    t = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(click(0).alias("a"), click(1).alias("b"))
    winner = F.when(F.col("a") + F.col("b") == 0, "no click").when(F.col("a") > F.col("b"), "A").when(F.col("b") > F.col("a"), "B").otherwise("tie")
    return t.groupBy(winner.alias("winner")).agg(F.count("*").alias("n"))


@query("""select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as mean, round(avg((value < 1)::int), 6) as small_share from events group by 1""")
def event_summary(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.avg(F.when(F.col("value") < 1, 1).otherwise(0)), 6).alias("small_share"),
    )


@query("""with t as (select conv_id, role, text, turn, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, count(*) as n_turns, count(*) filter (role = before) as repeated_role, count(*) filter (before is not null and role <> before) as exchanges,
  arg_min(role, turn) as first_role, max(length(text)) as longest from t group by 1""")
def dialogue_turns(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").withColumn("before", before)
    return t.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == F.col("before")).alias("repeated_role"),
        F.count_if(F.col("role") != F.col("before")).alias("exchanges"), F.min_by("role", "turn").alias("first_role"),
        F.max(F.length("text")).cast("long").alias("longest"),
    )


@query("""select time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by 1""")
def tumbling_counts_streamed(spark, sf_dir):
    """The events table read as a stream, counted by the hour with a watermark, and taken when all is read."""
    from corpusmill.streaming.windows import streamed_counts

    return streamed_counts(spark, f"{sf_dir}/events.parquet").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query()
def dialogue_state_streamed(spark, sf_dir):
    """The state of each conversation after its turns went through a stateful operator."""
    from corpusmill.streaming.dialogue import streamed_states

    return streamed_states(spark, f"{sf_dir}/conversations.parquet")
