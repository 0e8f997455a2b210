"""Studies of runs: families of tests, agreement of systems, restricted catalogues, failures, routing.

Runs are (system, qid, doc_id, rank, score), per-query values (system, qid, v), query attributes (qid, kind, ...).
Systems and kinds of queries are few; queries and documents may be many.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import plain_tokens, unit_hash
from corpusmill.operators.evaluation import holm, kendall_tau, sign_flip_test


def reciprocal_ranks(ranks: DataFrame, cut: int = 10) -> DataFrame:
    """(system, qid, v): reciprocal rank, 0 beyond ``cut`` or where the target is missing."""
    return ranks.select("system", "qid", F.when(F.col("rank") <= cut, 1.0 / F.col("rank")).otherwise(0.0).alias("v"))


def _macro_weights(values: DataFrame, kinds: DataFrame) -> DataFrame:
    """``values`` (qid, d) with kind and weight: each kind has the same weight, shared by its queries."""
    own = values.join(kinds, "qid")
    sizes = own.groupBy("kind").agg(F.count("*").alias("n"))
    n_kinds = sizes.agg(F.count("*").alias("k"))
    return own.join(sizes, "kind").crossJoin(n_kinds).withColumn("w", 1.0 / (F.col("k") * F.col("n")))  # n_kinds: one row


def macro_flip_test(diffs: DataFrame, kinds: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(obs, p): sign-flip test of a macro difference; all queries of one ``cluster`` change sign together.

    ``diffs`` is (qid, d), ``kinds`` (qid, kind, cluster).
    """
    summed = _macro_weights(diffs, kinds).groupBy(F.col("cluster").alias("key")).agg(F.sum(F.col("w") * F.col("d")).alias("d"))
    n = summed.agg(F.count("*").alias("n"))
    test = sign_flip_test(summed, permutations, seed)  # of the mean over clusters: the same order as of the sum
    return test.crossJoin(n).select((F.col("obs") * F.col("n")).alias("obs"), "p")


def macro_bootstrap(values: DataFrame, kinds: DataFrame, samples: int = 500, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(mean, low, high): interval of the mean over kinds of (qid, v); a drawn cluster brings all its queries."""
    own = values.join(kinds, "qid")
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "cluster"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # how often a cluster is drawn: Poisson with mean 1, by its distribution function
    steps, at, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(9):
        at, p = at + p, p / (k + 1)
        steps = steps + (u > at).cast("int")
    drawn = own.groupBy("kind", "cluster").agg(F.sum("v").alias("s"), F.count("*").alias("c")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("n", steps)
    per_kind = drawn.groupBy("b", "kind").agg(F.try_divide(F.sum(F.col("n") * F.col("s")), F.sum(F.col("n") * F.col("c"))).alias("m"))
    tail = (1 - level) / 2
    interval = per_kind.groupBy("b").agg(F.avg("m").alias("m")).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("i"))
    mean = own.groupBy("kind").agg(F.avg("v").alias("m")).agg(F.avg("m").alias("mean"))
    return mean.crossJoin(interval).select("mean", F.col("i")[0].alias("low"), F.col("i")[1].alias("high"))


def paired_summary(values: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_a, mean_b, delta, wins, losses) of system b against a on the queries that both have."""
    both = values.where(F.col("system").isin(a, b)).groupBy("qid").agg(
        F.max(F.when(F.col("system") == a, F.col("v"))).alias("a"), F.max(F.when(F.col("system") == b, F.col("v"))).alias("b")
    ).where("a is not null and b is not null")
    return both.agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("delta"),
        F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"),
    )


def _differences(values: DataFrame, a: str, b: str) -> DataFrame:
    sign = F.when(F.col("system") == b, F.col("v")).when(F.col("system") == a, -F.col("v"))
    rows = values.where(F.col("system").isin(a, b)).groupBy(F.col("qid").alias("key")).agg(F.sum(sign).alias("d"), F.count_distinct("system").alias("n"))
    return rows.where("n = 2").select("key", "d")


def comparison_family(values: DataFrame, comparisons: list[tuple[str, str]], permutations: int = 500) -> DataFrame:
    """(name, n, mean_a, mean_b, delta, wins, losses, p, p_holm): all comparisons of a family, corrected together."""
    rows = tests = None
    for a, b in comparisons:
        label = F.lit(f"{a}~{b}").alias("name")
        one = paired_summary(values, a, b).select(label, "*")
        test = sign_flip_test(_differences(values, a, b), permutations).select(label, "p")
        rows, tests = (one, test) if rows is None else (rows.unionByName(one), tests.unionByName(test))
    return rows.join(holm(tests), "name")


def discriminative_power(values: DataFrame, alpha: float = 0.05, permutations: int = 200) -> DataFrame:
    """(pairs, significant, share): of all pairs of systems those whose difference the paired test finds."""
    systems = sorted(r[0] for r in values.select("system").distinct().collect())  # one row a system
    tests = None
    for a, b in combinations(systems, 2):
        one = sign_flip_test(_differences(values, a, b), permutations).select("p")
        tests = one if tests is None else tests.unionByName(one)
    tests = values.select(F.lit(1.0).alias("p")).limit(0) if tests is None else tests
    return tests.agg(F.count("*").alias("pairs"), F.count_if(F.col("p") < alpha).alias("significant")).withColumn("share", F.round(F.col("significant") / F.col("pairs"), 6))


def kind_scores(values: DataFrame, kinds: DataFrame) -> DataFrame:
    """(system, kind, v): means of each kind of query."""
    return values.join(kinds.select("qid", "kind"), "qid").groupBy("system", "kind").agg(F.avg("v").alias("v"))


def leave_one_out_agreement(scores: DataFrame) -> DataFrame:
    """(kind, tau): does the order of systems on one kind agree with that on the mean of the others?"""
    total = scores.groupBy("system").agg(F.sum("v").alias("s"), F.count("*").alias("k"))
    rest = scores.join(total, "system").select("kind", F.col("system").alias("name"), F.col("v").alias("x"), ((F.col("s") - F.col("v")) / (F.col("k") - 1)).alias("y"))
    return _tau_by(rest, "kind")


def kind_agreement(scores: DataFrame) -> DataFrame:
    """(kind_a, kind_b, tau) of the orders of systems on two kinds."""
    a = scores.select(F.col("kind").alias("kind_a"), F.col("system").alias("name"), F.col("v").alias("x"))
    b = scores.select(F.col("kind").alias("kind_b"), F.col("system").alias("name"), F.col("v").alias("y"))
    both = a.join(b, "name").where("kind_a < kind_b").withColumn("kind", F.struct("kind_a", "kind_b"))
    return _tau_by(both.select("kind", "name", "x", "y"), "kind").select("kind.kind_a", "kind.kind_b", "tau")


def _tau_by(rows: DataFrame, by: str) -> DataFrame:
    """Kendall's tau-b of x and y over the names of each group; null where one of them is constant."""
    left = rows.select(by, F.col("name").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = rows.select(by, F.col("name").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = left.join(right, by).where("n1 < n2")  # systems are few
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    untied = lambda c: F.count_if(F.col(f"{c}1") != F.col(f"{c}2")).cast("double")
    return pairs.groupBy(by).agg(F.round(F.try_divide(F.sum(s), F.sqrt(untied("x") * untied("y"))), 6).alias("tau"))


def mixture_sensitivity(scores: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """(first, n): how often each system leads when kinds get random weights (exponential, which is Dirichlet up to scale)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", "kind"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = scores.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("draw", "system").agg(F.sum(-F.log(u) * F.col("v")).alias("m"))
    lead = drawn.groupBy("draw").agg(F.max(F.struct("m", "system")).alias("top"))
    return lead.groupBy(F.col("top.system").alias("first")).agg(F.count("*").alias("n"))


def restricted_catalogue(ranks_of: DataFrame, targets: DataFrame, groups: DataFrame, fractions: tuple[float, ...], repetitions: int = 3, seed: int = 1) -> DataFrame:
    """(system, fraction, mrr10): runs searched again among a hash-chosen part of the groups, the target's always kept."""
    u = unit_hash(F.concat_ws(":", "rep", F.format_string("%.2f", "fraction"), F.col("cluster").cast("string")), str(seed))
    grid = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(r).alias("rep")) for f in fractions for r in range(repetitions if f < 1 else 1)]))
    grouped = ranks_of.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    wanted = targets.join(groups, "doc_id", "left").select("qid", F.coalesce("cluster", "doc_id").alias("cluster"), F.lit(True).alias("wanted")).distinct()
    each = grouped.join(wanted, ["qid", "cluster"], "left").select("*", grid.alias("g")).select("*", "g.*").drop("g")
    kept = each.where(F.col("wanted") | (F.col("fraction") >= 1) | (u < F.col("fraction"))).groupBy("system", "qid", "fraction", "rep", "cluster").agg(F.min("rank").alias("r"), F.max("wanted").alias("wanted"))
    place = kept.withColumn("place", F.row_number().over(Window.partitionBy("system", "qid", "fraction", "rep").orderBy("r")))
    found = place.groupBy("system", "qid", "fraction", "rep").agg(F.min(F.when(F.col("wanted"), F.col("place"))).alias("place"))
    every = ranks_of.select("system").distinct().crossJoin(targets.select("qid").distinct()).select("*", grid.alias("g")).select("system", "qid", "g.*")  # systems are few
    rr = F.when(F.col("place") <= 10, 1.0 / F.col("place")).otherwise(0.0)
    return every.join(found, ["system", "qid", "fraction", "rep"], "left").groupBy("system", "fraction").agg(F.round(F.avg(rr), 6).alias("mrr10"))


def failure_profile(ranks: DataFrame, queries: DataFrame, targets: DataFrame, docs: DataFrame, cut: int = 10) -> DataFrame:
    """(system, fail, n, overlap, length): queries that fail and that don't, by the share of their words that the target holds."""
    text = docs.select("doc_id", F.array_distinct(plain_tokens(F.col("text"))).alias("held"))
    asked = queries.select("qid", plain_tokens(F.col("text")).alias("q"))
    shares = targets.join(text, "doc_id").join(asked, "qid").select(
        "qid", F.size("q").alias("length"), F.when(F.size("q") > 0, F.size(F.filter("q", lambda w: F.array_contains("held", w))) / F.size("q")).otherwise(0.0).alias("overlap")
    )
    best = shares.groupBy("qid").agg(F.max("overlap").alias("overlap"), F.max("length").alias("length"))
    rows = ranks.join(best, "qid").withColumn("fail", F.coalesce(F.col("rank") > cut, F.lit(True)))
    return rows.groupBy("system", "fail").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("overlap"), F.round(F.avg("length"), 6).alias("length"))


def failure_sample(ranks: DataFrame, runs: DataFrame, groups: DataFrame, cut: int = 10, per_system: int = 20) -> DataFrame:
    """(system, qid, rank, first): queries whose target is beyond ``cut``, a hash-chosen few of them, with the first three groups found."""
    failed = ranks.where(F.coalesce(F.col("rank") > cut, F.lit(True)))
    chosen = failed.withColumn("k", F.row_number().over(Window.partitionBy("system").orderBy(F.md5(F.col("qid").cast("string")), "qid"))).where(F.col("k") <= per_system)
    firsts = runs.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id")).groupBy("system", "qid", "cluster").agg(F.min("rank").alias("r"))
    three = firsts.withColumn("place", F.row_number().over(Window.partitionBy("system", "qid").orderBy("r"))).where("place <= 3")
    listed = three.groupBy("system", "qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "cluster"))), lambda s: s["cluster"].cast("string")), ",").alias("first"))
    return chosen.select("system", "qid", "rank").join(listed, ["system", "qid"], "left")


def score_table(values: DataFrame, kinds: DataFrame, base: str, permutations: int = 200, alpha: float = 0.05) -> DataFrame:
    """(system, kind, v, mark): means of each kind; a star where the difference from ``base`` on all queries is significant."""
    others = sorted(r[0] for r in values.select("system").distinct().collect() if r[0] != base)  # one row a system
    marks = values.select(F.lit(base).alias("system"), F.lit("").alias("mark")).limit(1)
    for s in others:
        test = sign_flip_test(_differences(values, base, s), permutations)
        marks = marks.unionByName(test.select(F.lit(s).alias("system"), F.when(F.col("p") < alpha, "*").otherwise("").alias("mark")))
    return kind_scores(values, kinds).join(marks, "system", "left").select("system", "kind", F.round("v", 6).alias("v"), F.coalesce("mark", F.lit("")).alias("mark"))


def margins(runs: DataFrame) -> DataFrame:
    """(system, qid, top, margin): the best score of a list and how far the second lies behind, as a share of it."""
    place = F.row_number().over(Window.partitionBy("system", "qid").orderBy(F.desc("score"), "doc_id"))
    two = runs.withColumn("k", place).where("k <= 2").groupBy("system", "qid").agg(F.max(F.when(F.col("k") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))
    return two.select("system", "qid", "top", F.when(F.col("top") > 0, (F.col("top") - F.coalesce("second", F.lit(0.0))) / F.col("top")).otherwise(0.0).alias("margin"))


def routed_by_margin(runs: DataFrame, sure: str, other: str, quantile: float) -> DataFrame:
    """The list of ``sure`` where its margin reaches a quantile of all its margins, else the list of ``other``."""
    own = margins(runs).where(F.col("system") == sure)
    theta = own.agg(F.percentile("margin", F.lit(quantile)).alias("theta"))
    pick = own.crossJoin(theta).select("qid", F.when(F.col("margin") >= F.col("theta"), sure).otherwise(other).alias("system"))  # theta: one row
    asked = runs.select("qid").distinct().join(pick, "qid", "left").select("qid", F.coalesce("system", F.lit(other)).alias("system"))
    return runs.join(asked, ["qid", "system"])


def convex_grid(runs: DataFrame, targets: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """(alpha, mrr10) of alpha * scaled scores of b + (1 - alpha) * those of a, for every step."""
    one = Window.partitionBy("system", "qid")
    low, high = F.min("score").over(one), F.max("score").over(one)
    scaled = runs.where(F.col("system").isin(a, b)).withColumn("s", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))
    both = scaled.groupBy("qid", "doc_id").agg(*(F.coalesce(F.max(F.when(F.col("system") == x, F.col("s"))), F.lit(0.0)).alias(n) for x, n in ((a, "sa"), (b, "sb"))))
    alpha = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / float(steps))).alias("alpha")
    mixed = both.select("qid", "doc_id", "sa", "sb", alpha).select("alpha", "qid", "doc_id", F.round(F.col("alpha") * F.col("sb") + (1 - F.col("alpha")) * F.col("sa"), 9).alias("s"))
    own = mixed.join(targets, ["qid", "doc_id"]).groupBy("alpha", "qid").agg(F.max("s").alias("own"))
    rank = mixed.join(own, ["alpha", "qid"]).where("s >= own").groupBy("alpha", "qid").agg(F.count("*").alias("rank"))
    every = targets.select("qid").distinct().select("qid", alpha)
    rr = F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)
    return every.join(rank, ["alpha", "qid"], "left").groupBy("alpha").agg(F.round(F.avg(rr), 6).alias("mrr10"))


def _vector_ranks(runs: DataFrame, targets: DataFrame, systems: list[str], values: tuple, k: int = 60) -> DataFrame:
    """(g, qid, rr): reciprocal rank of each query under each weight vector."""
    from corpusmill.operators.fusion import weight_grid

    pivoted = runs.groupBy("qid", "doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("system") == s, 1.0 / (k + F.col("rank")))), F.lit(0.0)).alias(f"r_{s}") for s in systems])
    grid = weight_grid(runs.sparkSession, systems, values)
    score = sum((F.col(s) * F.col(f"r_{s}") for s in systems), F.lit(0.0))
    scored = pivoted.crossJoin(grid).select("g", "qid", "doc_id", F.round(score, 9).alias("score"))  # a small grid
    own = scored.join(targets, ["qid", "doc_id"]).groupBy("g", "qid").agg(F.max("score").alias("own")).where("own > 0")
    rank = scored.join(own, ["g", "qid"]).where("score >= own").groupBy("g", "qid").agg(F.count("*").alias("rank"))
    rr = F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)
    return targets.select("qid").distinct().crossJoin(grid.select("g")).join(rank, ["g", "qid"], "left").select("g", "qid", rr.alias("rr"))


def adaptive_weights(runs: DataFrame, targets: DataFrame, kinds: DataFrame, systems: list[str], folds: int = 5, values: tuple = (0.0, 0.5, 1.0, 2.0), save=None) -> DataFrame:
    """(kind, weights, mrr, cv_kind, cv_global, own): fusion weights of each kind of query.

    A kind keeps weights of its own only if they beat the weights of all queries in cross-validation: both are
    chosen without the queries of a fold and scored on them. The table of (weights, query) is worked out once;
    ``save`` may write it. Ties go to the smaller weight label.
    """
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col("qid").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    rr = _vector_ranks(runs, targets, systems, values).join(kinds.select("qid", "kind"), "qid").withColumn("fold", fold)
    rr = save(rr) if save else rr
    sums = rr.groupBy("g", "kind", "fold").agg(F.sum("rr").alias("s"), F.count("*").alias("n"))  # weights x kinds x folds rows
    of_kind = sums.groupBy("g", "kind").agg(F.sum("s").alias("ks"), F.sum("n").alias("kn"))
    of_all = of_kind.groupBy("g").agg(F.sum("ks").alias("gs"), F.sum("kn").alias("gn"))
    best = lambda df, by, value: df.groupBy(*by).agg(F.min_by("g", F.struct(-F.round(value, 10), F.col("g"))).alias("g"))
    whole = best(of_all.withColumn("one", F.lit(1)), ["one"], F.col("gs") / F.col("gn")).select(F.col("g").alias("g_all"))
    own = best(of_kind, ["kind"], F.col("ks") / F.col("kn")).withColumnRenamed("g", "g_kind")
    # without a fold of the kind's own queries
    left = sums.join(of_kind, ["g", "kind"]).join(of_all, "g").select("kind", "fold", "g", "s", "n", (F.col("ks") - F.col("s")).alias("rest"), (F.col("kn") - F.col("n")).alias("rest_n"), (F.col("gs") - F.col("s")).alias("all"), (F.col("gn") - F.col("n")).alias("all_n"))
    pick_kind = best(left, ["kind", "fold"], F.try_divide(F.col("rest"), F.col("rest_n")))
    pick_all = best(left, ["kind", "fold"], F.try_divide(F.col("all"), F.col("all_n")))
    held = lambda pick, name: pick.join(left, ["kind", "fold", "g"]).groupBy("kind").agg((F.sum("s") / F.sum("n")).alias(name))
    cv = held(pick_kind, "cv_kind").join(held(pick_all, "cv_global"), "kind")
    chosen = own.join(cv, "kind").crossJoin(whole).withColumn("own", F.col("cv_kind") > F.col("cv_global"))  # whole: one row
    chosen = chosen.withColumn("weights", F.when(F.col("own"), F.col("g_kind")).otherwise(F.col("g_all")))
    fits = of_kind.select("kind", F.col("g").alias("weights"), (F.col("ks") / F.col("kn")).alias("mrr"))
    return chosen.join(fits, ["kind", "weights"]).select("kind", "weights", F.round("mrr", 6).alias("mrr"), F.round("cv_kind", 6).alias("cv_kind"), F.round("cv_global", 6).alias("cv_global"), "own")


def opening_candidates(queries: DataFrame, docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(qid, length, n): how many texts hold the first words of a query in a row, for each length that it has."""
    from corpusmill.operators.retrieval import phrase_matches

    words = queries.select("qid", plain_tokens(F.col("text")).alias("w"))
    cuts = words.select("qid", "w", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length")).where(F.size("w") >= F.col("length"))
    asked = cuts.select(F.concat_ws(":", "qid", "length").alias("qid"), F.array_join(F.slice("w", F.lit(1), F.col("length")), " ").alias("text"))
    found = phrase_matches(docs, asked, plain_tokens(F.col("text"))).groupBy("qid").agg(F.count("*").alias("n"))
    parts = F.split("qid", ":")
    return asked.select("qid").join(found, "qid", "left").select(parts[0].cast("long").alias("qid"), parts[1].cast("int").alias("length"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def overlap_with_targets(queries: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, overlap, other): share of a query's words that its target holds, and that the text next to it in id order holds."""
    held = docs.select("doc_id", F.array_distinct(plain_tokens(F.col("text"))).alias("held"))
    n = docs.agg(F.max("doc_id").alias("last"))
    other = targets.crossJoin(n).select("qid", F.pmod(F.col("doc_id") + 1, F.col("last") + 1).alias("doc_id"))  # n: one row
    asked = queries.select("qid", plain_tokens(F.col("text")).alias("q"))

    def share(pairs: DataFrame, name: str) -> DataFrame:
        rows = pairs.join(held, "doc_id").join(asked, "qid").where(F.size("q") > 0)
        return rows.groupBy("qid").agg(F.round(F.max(F.size(F.filter("q", lambda w: F.array_contains("held", w))) / F.size("q")), 6).alias(name))

    return share(targets, "overlap").join(share(other, "other"), "qid", "left")


def system_tau(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(tau) of the systems' orders on two kinds."""
    one = lambda k, n: scores.where(F.col("kind") == k).select(F.col("system").alias("name"), F.col("v").alias(n))
    return kendall_tau(one(a, "x").join(one(b, "y"), "name"))


def oracle_kind(kind: Column) -> Column:
    """The kind whose weights a variant of queries takes: levels of noise are exact at 0 and noisy above; variants count as their source."""
    # Variants and their sources.
    variants = F.create_map(*[F.lit(x) for x in ("Q3u", "Q3", "Q4s", "Q4", "Q5g", "Q5")])
    level = F.regexp_extract(kind, r"^[NEW](\d+)$", 1)
    return F.when(level == "0", "Q1").when(level != "", "Q3").otherwise(F.coalesce(variants[kind], kind))
