"""Upserts, merges, match cascades and other relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each value of ``by``: the first in ``order``, which has to be total."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def upsert(rows: DataFrame, key: str, seq: str, least: list[str] = (), keep_known: list[str] = ()) -> DataFrame:
    """State after writing ``rows`` in order of ``seq``: the newest value of each column.

    Columns of ``least`` keep their minimum, those of ``keep_known`` their newest value that is not null.
    One aggregation with map-side combine, however often a key is written.
    """
    newest = [c for c in rows.columns if c not in (key, *least, *keep_known)]
    out = [F.max_by(F.struct(*newest), seq).alias("_new")]
    out += [F.min(c).alias(c) for c in least]
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_known]
    done = rows.groupBy(key).agg(*out)
    return done.select(key, *[F.col(f"_new.{c}").alias(c) for c in newest], *least, *keep_known)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new to ``target``, one for each value of ``keys``."""
    return rows.dropDuplicates(keys).join(target, keys, "left_anti")


def merge_in_order(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union where the first source that has a key wins, and in it the smallest ``order``; null keys are left out.

    new_id goes on through the sources: rows are numbered by source, then ``order``. The number comes
    from counts of each source and a rank within it.
    """
    tagged = [s.where(F.col(key).isNotNull()).withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    kept = first_of(union, [key], ["source_no", order])
    counts = kept.groupBy("source_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    offsets = counts.select("source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("source_no").orderBy(order))
    return kept.withColumn("_own", own).join(offsets, "source_no").withColumn("new_id", F.col("_before") + F.col("_own")).drop("_own", "_before")


def match_cascade(left: DataFrame, right: DataFrame, base: str, exact: str, size: str, near: float, far: float) -> DataFrame:
    """Record linkage: (l_id, r_id, rule, diff), the best partner of each left row.

    Rows meet on ``base``; rules in order: equal ``exact`` with sizes within ``near``; equal ``exact`` within
    ``far``; else within 3 times ``far``. Of one rule the nearest size wins, then the smaller id.
    """
    best = lambda met: met.groupBy("l_id").agg(F.min(F.struct("rule", "diff", "r_id")).alias("m")).select("l_id", "m.r_id", "m.rule", "m.diff")
    a = left.select(F.col("id").alias("l_id"), F.col(base).alias("b"), F.col(exact).alias("x"), F.col(size).alias("l_s"))
    b = right.select(F.col("id").alias("r_id"), F.col(base).alias("b"), F.col(exact).alias("x"), F.col(size).alias("r_s"))
    diff = F.abs(F.col("l_s") - F.col("r_s")).alias("diff")

    def met(own, keys, width, rule):
        """Partners lie in the same cell of sizes or beside it."""
        cell = lambda c: F.floor(F.col(c) / width)
        near_cells = own.withColumn("cell", F.explode(F.sequence(cell("l_s") - 1, cell("l_s") + 1)))
        pairs = near_cells.drop("x" if "x" not in keys else "").join(b.withColumn("cell", cell("r_s")), [*keys, "cell"]).where("l_id <> r_id")
        return pairs.select("l_id", "r_id", diff).where(F.col("diff") <= width).select("l_id", "r_id", rule.alias("rule"), "diff")

    first = best(met(a, ["b", "x"], far, F.when(F.col("diff") <= near, 0).otherwise(1)))
    rest = best(met(a.join(first, "l_id", "left_anti"), ["b"], 3 * far, F.lit(2)))  # only those without a partner so far
    return first.unionByName(rest)


def top_values(df: DataFrame, attributes: list[str], k: int) -> DataFrame:
    """(attribute, value, n): the k most frequent values of each attribute, ties to the smaller value. Arrays count each value once."""
    kinds = dict(df.dtypes)
    values = [F.array_distinct(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string")) for c in attributes]
    named = lambda a: lambda x: F.struct(F.lit(a).alias("attribute"), x.alias("value"))
    pairs = F.flatten(F.array(*[F.transform(v, named(a)) for a, v in zip(attributes, values, strict=True)]))
    counts = df.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value"))
    return counts.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def with_facets(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Rows that have one of the values for every attribute of ``filters``."""
    for c, values in filters.items():
        df = df.where(F.col(c).isin(*values))
    return df


def collapse(run: DataFrame, groups: DataFrame, cap: int) -> DataFrame:
    """First hit of each group of a query with the number of its versions; items without a group stand alone.

    ``run`` has (qid, doc_id, rank), ``groups`` (doc_id, cluster).
    """
    own = run.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    firsts = own.groupBy("qid", "cluster").agg(F.min_by("doc_id", "rank").alias("doc_id"), F.min("rank").alias("first_rank"), F.count("*").alias("versions"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("first_rank"))
    return firsts.withColumn("rank", place).where(F.col("rank") <= cap).select("qid", "doc_id", "cluster", "versions", "rank")


def completeness(df: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """(group, n_rows, one share for each column): how many values are neither null nor empty."""
    full = [F.round(100.0 * F.count_if(F.trim(F.col(c).cast("string")) != "") / F.count("*"), 4).alias(f"{c}_percent") for c in columns]
    return df.groupBy(by.alias("group_key")).agg(F.count("*").alias("n_rows"), *full)
