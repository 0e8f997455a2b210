"""Statistics of a whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens


def zipf_fit(docs: DataFrame, least: int = 5) -> DataFrame:
    """(slope, r2, n_types) of ln frequency on ln rank over types with ``least`` occurrences.

    Types are counted first and then frequencies, so that ranks come from a window over distinct
    frequencies: the types of one frequency hold consecutive ranks, spread out again by ``sequence``.
    """
    types = docs.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("f"))
    by_f = types.where(F.col("f") >= least).groupBy("f").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = by_f.withColumn("above", F.coalesce(above, F.lit(0)))
    rows = ranked.select("f", F.explode(F.sequence(F.col("above") + 1, F.col("above") + F.col("n"))).alias("rank"))
    y, x = F.log("f"), F.log("rank")
    return rows.agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_r2(y, x), 4).alias("r2"), F.count("*").alias("n_types"))
