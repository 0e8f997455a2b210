"""Running sums over many rows that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sum_before(df: DataFrame, by: list[str], order: str, value: Column, out: str, span: int = 4096) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over rows of the same ``by`` with a smaller ``order``.

    ``order`` is a whole number from 0, unique within ``by``. Stretches of ``span`` values are summed
    first, so one window holds at most ``span`` rows and the other one row for each stretch.
    """
    own = df.withColumn("_v", value.cast("long")).withColumn("_s", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = own.groupBy(*by, "_s").agg(F.sum("_v").alias("_t"))
    before = stretches.withColumn("_b", F.coalesce(F.sum("_t").over(across), F.lit(0))).drop("_t")
    return (
        own.join(before, [*by, "_s"])
        .withColumn(out, F.col("_b") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .select(*df.columns, out)
    )
