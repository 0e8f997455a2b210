"""Evaluation of runs: ranks after collapse, metrics, significance, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_ranks(runs: DataFrame, targets: DataFrame, groups: DataFrame, depth: int = 100) -> DataFrame:
    """(system, qid, rank): place of the target's group when each group counts once; null where it is not among ``depth``.

    ``runs`` (system, qid, doc_id, rank), ``targets`` (qid, doc_id), ``groups`` (doc_id, cluster); a document
    without a group is one of its own.
    """
    grouped = lambda t: t.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    firsts = grouped(runs).groupBy("system", "qid", "cluster").agg(F.min("rank").alias("r"))
    place = F.row_number().over(Window.partitionBy("system", "qid").orderBy("r"))
    placed = firsts.withColumn("rank", place).where(F.col("rank") <= depth)
    wanted = grouped(targets).select("qid", "cluster").distinct()
    best = placed.join(wanted, ["qid", "cluster"]).groupBy("system", "qid").agg(F.min("rank").alias("rank"))
    every = runs.select("system").distinct().crossJoin(targets.select("qid").distinct())  # systems are few
    return every.join(best, ["system", "qid"], "left")


def known_item_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Means of reciprocal rank cut at 10, success at 1 and 10, recall at 100, MAP and NDCG at 10."""
    r = F.col("rank")
    when = lambda cond, value: F.coalesce(F.when(cond, value), F.lit(0.0))
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(when(r <= 10, 1.0 / r)), 6).alias("mrr10"), F.round(F.avg(when(r <= 1, F.lit(1.0))), 6).alias("s1"),
        F.round(F.avg(when(r <= 10, F.lit(1.0))), 6).alias("s10"), F.round(F.avg(when(r <= 100, F.lit(1.0))), 6).alias("r100"),
        F.round(F.avg(when(r.isNotNull(), 1.0 / r)), 6).alias("map"), F.round(F.avg(when(r <= 10, 1.0 / F.log2(r + 1))), 6).alias("ndcg10"),
    )


def ranked_hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, rank, hit, hits, n_relevant, precision, recall) down each ranking; recall is null without relevant documents."""
    totals = qrels.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    own = run.join(qrels.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    down = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("hits", F.sum("hit").over(down)).join(totals, "qid", "left").select(
        "qid", "rank", "hit", "hits", "n_relevant", (F.col("hits") / F.col("rank")).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall")
    )


def graded_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, ap, p10, r_precision, ndcg10) of queries with relevant documents; others are left out."""
    hits = ranked_hits(run, qrels).where("n_relevant is not null")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return hits.groupBy("qid", "n_relevant").agg(
        F.sum(F.col("hit") * F.col("precision")).alias("s"), F.sum(F.when(F.col("rank") <= 10, F.col("hit")).otherwise(0)).alias("h10"),
        F.sum(F.when(F.col("rank") <= F.col("n_relevant"), F.col("hit")).otherwise(0)).alias("hr"),
        F.sum(F.when(F.col("rank") <= 10, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    ).select(
        "qid", F.round(F.col("s") / F.col("n_relevant"), 6).alias("ap"), F.round(F.col("h10") / 10, 6).alias("p10"),
        F.round(F.col("hr") / F.col("n_relevant"), 6).alias("r_precision"), F.round(F.col("dcg") / ideal, 6).alias("ndcg10"),
    )


def precision_at_recall(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(level, precision): interpolated precision at the 11 recall levels, the mean over queries with relevant documents."""
    hits = ranked_hits(run, qrels).where("n_relevant is not null")
    levels = hits.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10))))
    best = levels.groupBy("qid", "level").agg(F.coalesce(F.max(F.when(F.round(F.col("recall") * 10, 9) >= F.col("level"), F.col("precision"))), F.lit(0.0)).alias("p"))
    return best.groupBy("level").agg(F.round(F.avg("p"), 6).alias("precision"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each label of ``truth``."""
    labels = rows.select(F.col(truth).alias("label")).distinct()
    tp = rows.where(F.col(truth) == F.col(predicted)).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("tp"))
    said = rows.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    real = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"))
    all_ = labels.join(tp, "label", "left").join(said, "label", "left").join(real, "label", "left").na.fill(0)
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    f = F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return all_.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), "support")


def sign_flip_test(diffs: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(obs, p): two-sided paired randomisation test on (key, d). Signs come from hashes of permutation and key."""
    obs = diffs.agg(F.avg("d").alias("obs"))
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "perm", "key"), F.lit(2)) == 0, 1).otherwise(-1)
    means = diffs.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).groupBy("perm").agg(F.avg(sign * F.col("d")).alias("m"))
    return means.crossJoin(obs).agg(
        F.first("obs").alias("obs"), ((F.count_if(F.abs("m") >= F.abs("obs") - 1e-12) + 1) / (permutations + 1)).alias("p")
    )


def bootstrap_interval(values: DataFrame, samples: int = 500, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile interval of the mean of ``v``; each row enters a sample a Poisson number of times."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "key"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    n = F.aggregate(  # inverse of the distribution function of a Poisson variable with mean 1
        F.sequence(F.lit(0), F.lit(9)), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c"), F.lit(0.36787944117144233).alias("p")),
        lambda a, k: F.struct((a["n"] + F.when(u > a["c"] + a["p"], 1).otherwise(0)).alias("n"), (a["c"] + a["p"]).alias("c"), (a["p"] / (k + 1)).alias("p")),
    )["n"]
    drawn = values.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("n", n)
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("i"))
    return values.agg(F.avg("v").alias("mean")).crossJoin(interval).select("mean", F.col("i")[0].alias("low"), F.col("i")[1].alias("high"))


def holm(tests: DataFrame) -> DataFrame:
    """(name, p, p_holm): running maximum of (m - i) * p in order of p, at most 1. One row for each test."""
    m = tests.agg(F.count("*").alias("m"))
    order = Window.orderBy("p", "name")
    step = F.least(F.lit(1.0), (F.col("m") - F.row_number().over(order) + 1) * F.col("p"))
    stepped = tests.crossJoin(m).withColumn("step", step)
    return stepped.withColumn("p_holm", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("name", "p", "p_holm")


def kendall_tau(scores: DataFrame) -> DataFrame:
    """(tau) of two scores ``x`` and ``y`` over systems ``name``, ties in neither corrected (tau-b). Systems are few."""
    a = scores.select(F.col("name").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = scores.select(F.col("name").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    pairs = a.join(b, F.col("n1") < F.col("n2"))
    tied = lambda c: F.count_if(F.col(f"{c}1") != F.col(f"{c}2"))
    return pairs.agg(F.round(F.sum(s) / F.sqrt(tied("x").cast("double") * tied("y")), 6).alias("tau"))


def paired_t(diffs: DataFrame) -> DataFrame:
    """(mean, t, n) of paired differences ``d``; t is null where they are all alike."""
    sd = F.stddev_samp("d")
    return diffs.agg(F.avg("d").alias("mean"), F.when(sd > 0, F.avg("d") / (sd / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("n"))
