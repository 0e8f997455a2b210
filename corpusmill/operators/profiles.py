"""Summaries of collections, crawls and judgements; sets of records that are merged, audited or left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import has_phrase, tokens


def length_profile(docs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, median, p10, p90) of words a text."""
    sized = docs.select(*by, F.size(tokens(F.col("text"))).alias("w"))
    p = lambda x: F.percentile("w", F.lit(x))
    return sized.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def event_counters(log: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """(key, name, n, mean): how often each value of each of several columns stands in a log, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("name")) for k in keys])).alias("p")
    mean = F.round(F.avg("v"), 6) if value else F.lit(None).cast("double")
    return log.select(pairs, (F.col(value) if value else F.lit(None)).cast("double").alias("v")).groupBy("p.key", "p.name").agg(F.count("*").alias("n"), mean.alias("mean"))


def date_range(log: DataFrame, at: str, status: str) -> DataFrame:
    """(status, n, first, last)."""
    return log.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def origin_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both, only_a, only_b): distinct keys that two collections share and don't."""
    one, other = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return one.join(other, key, "full").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
    )


def pattern_counts(docs: DataFrame, by: str, patterns: dict[str, str]) -> DataFrame:
    """(by, pattern, n): texts that match each pattern, in one pass."""
    named = F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col("text").rlike(p), F.lit(False)).alias("hit")) for n, p in patterns.items()])
    return docs.select(by, F.explode(named).alias("p")).groupBy(by, "p.pattern").agg(F.count_if(F.col("p.hit")).alias("n"))


def chi_square_terms(rows: DataFrame, k: int, least: int = 5) -> DataFrame:
    """(label, term, chi2, place): the terms of (doc_id, label, text) that most set a label apart, ``k`` of each."""
    held = rows.select("doc_id", "label", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("in_label"))
    n = rows.agg(F.count("*").alias("n"))
    both = held.groupBy("label", "term").agg(F.count("*").alias("a"))
    total = both.groupBy("term").agg(F.sum("a").alias("df")).where(F.col("df") >= least)
    cells = both.join(total, "term").join(sizes, "label").crossJoin(n)  # one row
    a, df, m, all_ = (F.col(c).cast("double") for c in ("a", "df", "in_label", "n"))
    top = all_ * F.pow(a * (all_ - df - m + a) - (df - a) * (m - a), F.lit(2.0))
    chi = F.round(F.try_divide(top, df * (all_ - df) * m * (all_ - m)), 6)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("chi2"), "term"))
    return cells.select("label", "term", chi.alias("chi2")).where("chi2 is not null").withColumn("place", place).where(F.col("place") <= k)


def change_points(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, order, before, value): the places of a sequence where a value differs from the one before; nulls are skipped."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.where(F.col(value).isNotNull()).withColumn("before", before).where(F.col("before") != F.col(value)).select(by, order, "before", value)


def strongest_wins(sources: list[DataFrame], key: str, strength: Column) -> DataFrame:
    """One record a key of several sources: the strongest, and of equals the one of the first source."""
    both = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_no", F.lit(i))
        both = one if both is None else both.unionByName(one)
    order = Window.partitionBy(key).orderBy(strength.desc(), "source_no", F.xxhash64(*sources[0].columns))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def merge_report(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(source, total, added): records of each source, and those whose key no source before it has."""
    both = None
    for i, (name, s) in enumerate(sources.items()):
        one = s.select(F.lit(i).alias("no"), F.lit(name).alias("source"), F.col(key).alias("key"))
        both = one if both is None else both.unionByName(one)
    first = both.groupBy("key").agg(F.min("no").alias("no")).groupBy("no").agg(F.count("*").alias("added"))
    return both.groupBy("no", "source").agg(F.count("*").alias("total")).join(first, "no", "left").select("source", "total", F.coalesce("added", F.lit(0).cast("long")).alias("added"))


def checksum(rows: DataFrame) -> DataFrame:
    """(n, sum): equal for tables with the same rows, in whatever order."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))).alias("sum"))


def version_links(groups: DataFrame) -> DataFrame:
    """(doc_id, version): every member of a group with its first one, in both directions."""
    first = groups.groupBy("cluster").agg(F.min("doc_id").alias("version"))
    one = groups.join(first, "cluster").where("doc_id <> version").select("doc_id", "version")
    return one.unionByName(one.select(F.col("version").alias("doc_id"), F.col("doc_id").alias("version")))


def without_groups(rows: DataFrame, groups: DataFrame, out: DataFrame) -> DataFrame:
    """Rows whose document's group holds no document of ``out`` (doc_id): left-out pilots, or groups of training snapshots."""
    held = out.join(groups, "doc_id").select("cluster").distinct()
    return rows.join(groups, "doc_id").join(held, "cluster", "left_anti").select(*rows.columns)


def judgement_audit(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, judged, repeated, unknown, relevant, thin): judgements of a query, of them repeated and unknown ids; thin: fewer than two relevant."""
    known = docs.select("doc_id", F.lit(1).alias("known"))
    rows = judged.groupBy("qid", "doc_id").agg(F.count("*").alias("n"), F.max("grade").alias("grade")).join(known, "doc_id", "left")
    out = rows.groupBy("qid").agg(
        F.sum("n").alias("judged"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("grade") > 0).alias("relevant")
    )
    return out.withColumn("thin", F.col("relevant") < 2)


def unjudged_lookalikes(run: DataFrame, judged: DataFrame, depth: int) -> DataFrame:
    """(qid, doc_id, rank): documents among the first ``depth`` that nobody judged, of queries with judgements."""
    asked = judged.select("qid").distinct()
    return run.where(F.col("rank") <= depth).join(asked, "qid", "left_semi").join(judged.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "rank")


def whole_phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, doc_id, exact): texts that hold a phrase (qid, text) whole; exact: and nothing else. Phrases should be few."""
    own = docs.select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("t"))
    listed = phrases.select(F.array_join(tokens(F.col("text")), " ").alias("p"), "qid").where("p <> ''").agg(F.collect_list(F.struct("qid", "p")).alias("ps"))
    met = own.crossJoin(listed).select("doc_id", "t", F.explode("ps").alias("p"))  # one row of phrases
    return met.where(has_phrase(F.col("t"), F.col("p.p"))).select("p.qid", "doc_id", (F.col("t") == F.col("p.p")).alias("exact"))


def gold_texts(queries: DataFrame) -> DataFrame:
    """(qid, text, gold): variants with the text that they were made from; a text made from none is its own."""
    source = queries.select(F.col("qid").alias("origin"), F.col("text").alias("gold"))
    return queries.join(source, "origin", "left").select("qid", "text", F.coalesce("gold", "text").alias("gold"))


def quoting_replies(posts: DataFrame) -> DataFrame:
    """(post_id, reply_id): posts with later posts of their thread that quote them."""
    quoted = posts.select("thread", F.col("post_id"), F.col("n").alias("at"))
    replies = posts.where(F.col("quotes").isNotNull()).select("thread", F.col("quotes").alias("post_id"), F.col("post_id").alias("reply_id"), F.col("n").alias("later"))
    return quoted.join(replies, ["thread", "post_id"]).where("at < later").select("post_id", "reply_id")


def repaired_columns(rows: DataFrame, key: list[str], renamed: dict[str, str], empty: list[str], suffixes: dict[str, str]) -> DataFrame:
    """Columns renamed, empty strings as null, suffixes stripped, and of rows with one key that with the smallest id."""
    out = rows.withColumnsRenamed(renamed)
    out = out.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in empty} | {c: F.regexp_replace(c, p + "$", "") for c, p in suffixes.items()})
    order = Window.partitionBy(*key).orderBy("id")
    return out.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")


def inferred_tags(tags: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """(doc_id, tag, weight, place): tags of similar items, by the sum of similarity and count, that an item hasn't itself."""
    counted = tags.groupBy("doc_id", "tag").agg(F.count("*").alias("c"))
    moved = similar.join(counted.withColumnRenamed("doc_id", "other"), "other").groupBy("doc_id", "tag").agg(F.round(F.sum(F.col("score") * F.col("c")), 6).alias("weight"))
    new = moved.join(counted.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    return new.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "tag"))).where(F.col("place") <= k)
