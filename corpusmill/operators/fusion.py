"""Rank fusion over long run tables (system, qid, doc_id, rank, score)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import top_k


def _weight(weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(weights.items())])
    return F.coalesce(table[F.col("system")], F.lit(0.0))


def rrf(runs: DataFrame, weights: dict[str, float], k: int = 60, depth: int = 100) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank) over the first ``depth`` of each system; lists of weight 0 are skipped."""
    own = runs.where(F.col("rank") <= depth).withColumn("w", _weight(weights)).where("w <> 0")
    fused = own.groupBy("qid", "doc_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"))
    return top_k(fused, depth, places=9)


def comb_sum(runs: DataFrame, weights: dict[str, float], depth: int = 100) -> DataFrame:
    """Sum of scores scaled to 0..1 within each list; a list of equal scores gives 0."""
    one = Window.partitionBy("system", "qid")
    low, high = F.min("score").over(one), F.max("score").over(one)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0)
    own = runs.where(F.col("rank") <= depth).withColumn("w", _weight(weights)).where("w <> 0").withColumn("s", scaled)
    return top_k(own.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("s")).alias("score")), depth, places=9)


def weight_grid(spark, systems: list[str], values: tuple = (0.0, 0.5, 1.0, 2.0)) -> DataFrame:
    """(g, weights): every combination but all zeros."""
    grid = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = None
    for s in systems:
        one = grid.withColumnRenamed("v", s)
        out = one if out is None else out.crossJoin(one)  # a few values for each of a few systems
    total = sum((F.col(s) for s in systems), F.lit(0.0))
    return out.where(total > 0).withColumn("g", F.concat_ws("/", *[F.format_string("%.1f", F.col(s)) for s in systems]))


def tune_weights(runs: DataFrame, targets: DataFrame, systems: list[str], k: int = 60, values: tuple = (0.0, 0.5, 1.0, 2.0)) -> DataFrame:
    """(g, mrr, from_uniform): mean reciprocal rank, cut at 10, of every weight vector; ties count against the target.

    ``targets`` is (qid, doc_id). Reciprocal ranks of all systems stand in one row for a document, so each
    vector is one expression over it; candidates scoring at least the target's score are counted.
    """
    pivoted = runs.groupBy("qid", "doc_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("system") == s, 1.0 / (k + F.col("rank")))), F.lit(0.0)).alias(f"r_{s}") for s in systems]
    )
    grid = weight_grid(runs.sparkSession, systems, values)
    score = sum((F.col(s) * F.col(f"r_{s}") for s in systems), F.lit(0.0))
    scored = pivoted.crossJoin(grid).select("g", "qid", "doc_id", F.round(score, 9).alias("score"))
    own = scored.join(targets, ["qid", "doc_id"]).groupBy("g", "qid").agg(F.max("score").alias("own")).where("own > 0")
    rank = scored.join(own, ["g", "qid"]).where("score >= own").groupBy("g", "qid").agg(F.count("*").alias("rank"))
    asked = targets.select("qid").distinct()
    per = asked.crossJoin(grid).join(rank, ["g", "qid"], "left")
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 10)
    distance = sum((F.abs(F.col(s) - 1) for s in systems), F.lit(0.0))
    return per.groupBy("g", *systems).agg(mrr.alias("mrr")).withColumn("from_uniform", distance)


def list_features(runs: DataFrame, systems: list[str], depth: int = 100) -> DataFrame:
    """Learning-to-rank features of each query and candidate: for each list whether it has it, log rank
    (absent: depth + 1), reciprocal rank, and the score scaled to 0..1 (equal scores: 1)."""
    one = Window.partitionBy("system", "qid")
    low, high = F.min("score").over(one), F.max("score").over(one)
    own = runs.where(F.col("rank") <= depth).withColumn("s", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    out = []
    for s in systems:
        mine = F.col("system") == s
        rank = F.min(F.when(mine, F.col("rank")))
        out += [
            F.when(rank.isNull(), 0.0).otherwise(1.0).alias(f"{s}_in"), F.log(F.coalesce(rank, F.lit(depth + 1))).alias(f"{s}_log_rank"),
            F.coalesce(1.0 / (60 + rank), F.lit(0.0)).alias(f"{s}_rr"), F.coalesce(F.max(F.when(mine, F.col("s"))), F.lit(0.0)).alias(f"{s}_scaled"),
        ]
    return own.groupBy("qid", "doc_id").agg(*out)


def fit_ranker(features: DataFrame, label: str, columns: list[str], kind: str = "pointwise"):
    """A fitted model: logistic regression on rows, on differences of pairs, or boosted trees."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if kind == "pairwise":
        good = features.where(F.col(label) == 1).select("qid", *[F.col(c).alias(f"{c}_g") for c in columns])
        bad = features.where(F.col(label) == 0).select("qid", *columns)
        pairs = good.join(bad, "qid")  # one relevant row a query
        sign = F.when(F.hash(*columns) % 2 == 0, 1.0).otherwise(-1.0)
        features = pairs.withColumn("_s", sign).select(
            *[(F.col("_s") * (F.col(f"{c}_g") - F.col(c))).alias(c) for c in columns], F.when(F.col("_s") > 0, 1.0).otherwise(0.0).alias(label)
        )
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features.withColumn(label, F.col(label).cast("double")))
    if kind == "trees":
        return GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=1).fit(rows)
    return LogisticRegression(labelCol=label, fitIntercept=kind != "pairwise", regParam=0.01).fit(rows)


def rank_with(model, features: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Candidates by the model's probability."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    scored = model.transform(rows).select("qid", "doc_id", vector_to_array("probability")[1].alias("score"))
    return top_k(scored, k)


def interleave(runs: DataFrame, a: str, b: str, depth: int = 10, seed: str = "1") -> DataFrame:
    """Team-draft interleaving of two systems: (qid, place, doc_id, team); a seeded coin says who picks first in a round.

    Lists are cut at ``depth``, so a group holds 2 * depth rows.
    """
    import hashlib

    import pandas as pd

    def draft(rows: pd.DataFrame) -> pd.DataFrame:
        qid = rows["qid"].iloc[0]
        lists = {t: iter(rows[rows["system"] == t].sort_values("rank")["doc_id"].tolist()) for t in (a, b)}
        seen, out, round_no = set(), [], 0
        while len(out) < depth:
            coin = hashlib.md5(f"{seed}:{qid}:{round_no}".encode()).digest()[0] & 1
            before = len(out)
            for team in ((a, b), (b, a))[coin]:
                pick = next((d for d in lists[team] if d not in seen), None)
                if pick is not None and len(out) < depth:
                    seen.add(pick)
                    out.append((qid, len(out) + 1, pick, team))
            if len(out) == before:
                break
            round_no += 1
        return pd.DataFrame(out, columns=["qid", "place", "doc_id", "team"])

    kinds = dict(runs.dtypes)
    cut = runs.where(F.col("system").isin(a, b) & (F.col("rank") <= depth)).select("system", "qid", "doc_id", "rank")
    return cut.groupBy("qid").applyInPandas(draft, f"qid {kinds['qid']}, place int, doc_id {kinds['doc_id']}, team string")


def rerank(run: DataFrame, scores: DataFrame, depth: int, alpha: float = 1.0) -> DataFrame:
    """(qid, doc_id, rank): the first ``depth`` of (qid, doc_id, rank, score) ordered anew, the others behind them as they were.

    ``scores`` (qid, doc_id, new) may come from any model. Both scores are scaled to 0..1 among the first
    ``depth`` (equal scores: 0) and mixed with ``alpha`` for the new one; a document without a new score has 0.
    """
    head = Window.partitionBy("qid", F.col("rank") <= depth)
    scaled = lambda c: F.when(F.max(c).over(head) > F.min(c).over(head), (F.col(c) - F.min(c).over(head)) / (F.max(c).over(head) - F.min(c).over(head))).otherwise(0.0)
    both = run.join(scores, ["qid", "doc_id"], "left").na.fill({"new": 0.0})
    mixed = F.round(alpha * scaled("new") + (1 - alpha) * scaled("score"), 9)
    key = F.when(F.col("rank") <= depth, mixed)
    own = both.select("qid", "doc_id", "rank", key.alias("key"))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("key"), "rank", "doc_id")
    return own.withColumn("new_rank", F.row_number().over(order)).select("qid", "doc_id", F.col("new_rank").alias("rank"))
