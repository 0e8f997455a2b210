"""Interaction logs: clean-up, sessions, click metrics, co-use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_typing(log: DataFrame, seconds: float = 8.0) -> DataFrame:
    """Rows of (session, ts, query) but those that the next one of the session, sooner than ``seconds``, goes on from."""
    order = Window.partitionBy("session").orderBy("ts", "query")
    after, at = F.lead("query").over(order), F.lead("ts").over(order)
    seconds_of = lambda t: t.cast("timestamp").cast("double")
    gap = seconds_of(at) - seconds_of(F.col("ts"))
    typed = (gap < seconds) & (after != F.col("query")) & after.startswith(F.col("query"))
    return log.withColumn("_t", F.coalesce(typed, F.lit(False))).where("not _t").drop("_t")


def sessions(events: DataFrame, user: str, gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n_events) by gaps of inactivity; the state of a user is bounded by its open session."""
    return events.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select(
        user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events"
    )


def quantiles_by_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Elements number floor(share * n) of the sorted values, from 0. Values are counted first, ranks come from the counts."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(column))  # one row a distinct value
    total = counts.agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("upto", upto).crossJoin(total)
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("total") * s), F.col(column))).alias(name) for name, s in shares.items()])


def co_used(pairs: DataFrame, by: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n): ordered pairs of items that share ``by``, counted once for each; items of one ``by`` are made distinct first."""
    own = pairs.select(by, item).distinct()
    met = own.withColumnRenamed(item, "a").join(own.withColumnRenamed(item, "b"), by).where("a <> b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
