"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.durable import Scratch


def with_value(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with one row of ``values`` for each of ``keys``, an aggregate of the same rows.

    Joined on the keys alone, the aggregate would stand right below the join, where Spark can't split a
    partition in which one key has most rows. The hash beside the keys makes both sides shuffles of the join's own.
    """
    marked = (df.withColumn("mark_", F.xxhash64(*keys)) for df in (rows, values))
    left, right = marked
    return left.join(right, [*keys, "mark_"]).drop("mark_")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        with_value(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its lower neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_value(edges, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of any ordered type -> (node, root), root being the least node reachable.

    Only nodes that have an edge to another node appear. Each round is a written table, so the plan
    stays short and a lost executor costs one round at most. Rounds grow with the logarithm of the
    component size; the per-node minima are combined before the shuffle, and the join that brings them
    back has shuffles of its own (``with_value``), which Spark splits where one node has most edges. Null ends and self links are ignored.
    """
    links = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    now = scratch.save(links, f"{name}_0")
    before = _state(now)
    for k in range(1, max_rounds + 1):
        if not before[0]:
            break
        after_df = scratch.save(_small_star(_large_star(now)), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        now, after = after_df, _state(after_df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
