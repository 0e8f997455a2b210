"""What an interactive query goes through: expansion, mixtures of readings, boosts, kinds of queries, relations, next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clean, has_marks, strip_marks, tokens
from corpusmill.operators.retrieval import Index, idf, top_k
from corpusmill.operators.scoring import target_ranks
from corpusmill.plans.durable import Scratch


def expanded(query: DataFrame, synonyms: DataFrame, weight: float = 0.3) -> DataFrame:
    """(qid, term, qtf): query terms and, at a part of their weight, the synonyms (term, other) that the query lacks."""
    own = query.groupBy("qid", "term").agg(F.sum("qtf").cast("double").alias("qtf"))
    more = own.join(synonyms, "term").groupBy("qid", "other").agg((F.sum("qtf") * weight).alias("qtf")).withColumnRenamed("other", "term")
    return own.unionByName(more.join(own.select("qid", "term"), ["qid", "term"], "left_anti").select("qid", "term", "qtf"))


def reading_mixture(readings: DataFrame) -> DataFrame:
    """(qid, term, qtf): terms of several readings (qid, text, p) weighed by their share of the probability.

    BM25 is a sum over terms, so the score of this one query is the mixture of the readings' scores.
    """
    total = F.sum("p").over(Window.partitionBy("qid"))
    shared = readings.withColumn("share", F.col("p") / total)
    return shared.select("qid", "share", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.sum("share").alias("qtf"))


def evaluation_costs(index: Index, query: DataFrame) -> DataFrame:
    """(qid, terms, postings, documents): what evaluation term by term, and document by document, has to touch."""
    known = query.select("qid", "term").distinct().join(index.terms, "term")
    sums = known.groupBy("qid").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    met = index.postings.join(known.select("qid", "term"), "term").groupBy("qid").agg(F.count_distinct("doc_id").alias("documents"))
    return sums.join(met, "qid")


def boosted(run: DataFrame, facts: DataFrame, wishes: DataFrame, k: int) -> DataFrame:
    """A run with additions for what the query asks, in units of its best score M.

    ``facts`` is (doc_id, artist, title, mood, standing), ``wishes`` (qid, plain, artist, mood), all of them plain text
    or null. The artist that was asked for: M; the query is the title, of two words or more: M; it holds a title of
    three: M / 2; the mood: M / 4; the document's standing (0 to 1): M / 100 of it. Documents of the artist that
    the run lacks enter it with 0.
    """
    top = run.groupBy("qid").agg(F.max("score").alias("m"))
    asked = wishes.join(top, "qid", "left").withColumn("m", F.coalesce("m", F.lit(1.0 / 61)))
    own = facts.join(asked.where("artist is not null").select("qid", "artist"), "artist").select("qid", "doc_id")
    entered = own.join(run.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    pool = run.select("qid", "doc_id", "score").unionByName(entered)
    both = pool.join(facts.withColumnsRenamed({"artist": "by", "mood": "feels"}), "doc_id").join(asked, "qid")
    words = F.size(F.split("title", " "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    named = F.when((words >= 2) & (F.col("title") == F.col("plain")), 1.0).when((words >= 3) & padded(F.col("plain")).contains(padded(F.col("title"))), 0.5).otherwise(0.0)
    boost = F.when(F.col("by") == F.col("artist"), 1.0).otherwise(0.0) + named + F.when(F.col("feels") == F.col("mood"), 0.25).otherwise(0.0) + 0.01 * F.coalesce("standing", F.lit(0.0))
    return top_k(both.select("qid", "doc_id", (F.col("score") + F.col("m") * boost).alias("score")), k)


def query_features(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, marked, oov_marked, oov_plain, length): shares of a query's words that have marks and that no text holds, as they are and plain."""
    words = queries.select("qid", F.explode(F.when(F.size(tokens(F.col("text"))) > 0, tokens(F.col("text"))).otherwise(F.array(F.lit("")))).alias("w")).withColumn("p", strip_marks(F.col("w")))
    held = vocabulary.select(F.col("word").alias("w"), F.lit(1).alias("in_marked")).distinct()
    plain = vocabulary.select(strip_marks(F.col("word")).alias("p"), F.lit(1).alias("in_plain")).distinct()
    met = words.join(held, "w", "left").join(plain, "p", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return met.groupBy("qid").agg(
        share(has_marks(F.col("w"))).alias("marked"), share(F.col("in_marked").isNull()).alias("oov_marked"), share(F.col("in_plain").isNull()).alias("oov_plain"),
        F.round(F.least(F.count("*"), F.lit(40)) / 40.0, 6).alias("length"),
    )


def word_bound_ngrams(x: Column, least: int = 1, most: int = 4) -> Column:
    """Character n-grams inside words padded by a space on either side."""
    padded = F.transform(tokens(x), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda p, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))
    return F.flatten(F.transform(padded, lambda p: F.flatten(F.array(*[F.when(F.length(p) >= n, grams(p, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)]))))


def kind_folds(queries: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``queries`` with a fold, the same for all queries of a group."""
    return queries.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def classify_kinds(queries: DataFrame, vocabulary: DataFrame, folds: int = 5, bits: int = 12, model: str = "logistic") -> DataFrame:
    """(qid, kind, predicted, fold): the kind of each query by a model that was fitted without its fold.

    ``queries`` is (qid, text, kind, cluster); features are those of :func:`query_features` and hashed character
    n-grams, weighed by 1 + log of their counts.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer, VectorAssembler

    rows = kind_folds(queries, "cluster", folds).join(query_features(queries, vocabulary), "qid").withColumn("grams", word_bound_ngrams(F.col("text")))
    rows = Scratch(queries.sparkSession, "kinds").save(rows, "rows")  # every step of every fit reads them; the vocabulary is read once
    labels = StringIndexer(inputCol="kind", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    last = LogisticRegression(maxIter=30, regParam=0.01) if model == "logistic" else NaiveBayes(smoothing=0.1)
    steps = [
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=1 << bits, binary=True), IDF(inputCol="counts", outputCol="weighed", minDocFreq=2),
        VectorAssembler(inputCols=["marked", "oov_marked", "oov_plain", "length", "weighed"], outputCol="features"), last,
    ]
    out = None
    for f in range(folds):
        train, test = labels.transform(rows.where(F.col("fold") != f)), labels.transform(rows.where(F.col("fold") == f))
        if not train.limit(1).count() or not test.limit(1).count():
            continue
        said = Pipeline(stages=steps).fit(train).transform(test)
        one = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels).transform(said).select("qid", "kind", "predicted", "fold")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select("qid", "kind", F.col("kind").alias("predicted"), "fold").limit(0)


def relations(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, relation, subject, object): what patterns with two groups say in the cleaned lines of texts, each once."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", clean(F.col("line")).alias("line")).where("line <> ''")
    out = None
    for name, p in patterns.items():
        both = F.arrays_zip(F.regexp_extract_all("line", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("line", F.lit(p), F.lit(2)).alias("b"))
        one = lines.select("doc_id", F.lit(name).alias("relation"), F.explode(both).alias("r")).select("doc_id", "relation", F.col("r.a").alias("subject"), F.col("r.b").alias("object"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def events(docs: DataFrame, triggers: dict[str, str], agents: list[str], places: list[str], negations: list[str]) -> DataFrame:
    """(doc_id, line_no, at, trigger, type, agent, patient, place, negated): trigger words of lines with what stands around them.

    agent: the last agent before the trigger; patient: the first agent after it, within two words; place: the first
    place of the line; negated: a negation within two words before.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("w", tokens(F.col("line")))
    kinds = F.create_map(*[F.lit(x) for pair in triggers.items() for x in pair])
    listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    at = lines.select("doc_id", "line_no", "w", F.posexplode("w").alias("at", "trigger")).where(F.col("trigger").isin(*triggers))
    n = F.col("at")
    before = F.filter(F.slice("w", F.lit(1), n), lambda x: F.array_contains(listed(agents), x))
    near = F.filter(F.slice("w", n + 2, F.lit(3)), lambda x: F.array_contains(listed(agents), x))
    place = F.filter("w", lambda x: F.array_contains(listed(places), x))
    negated = F.arrays_overlap(F.slice("w", F.greatest(n - 1, F.lit(1)), F.least(n, F.lit(2))), listed(negations))
    return at.select(
        "doc_id", "line_no", "at", "trigger", kinds[F.col("trigger")].alias("type"), F.try_element_at(before, F.lit(-1)).alias("agent"),
        F.try_element_at(near, F.lit(1)).alias("patient"), F.try_element_at(place, F.lit(1)).alias("place"), (negated & (n > 0)).alias("negated"),
    )


def next_steps(turns: DataFrame, sure: float = 0.35, margin: float = 0.1) -> DataFrame:
    """``turns`` (..., intent, top, second, n_slots) with a step: answer, confirm, ask for more, or say that nothing was found."""
    step = (
        F.when(F.col("top").isNull(), "nothing").when(F.col("top") < sure, F.when(F.col("n_slots") == 0, "ask").otherwise("confirm"))
        .when(F.col("top") - F.coalesce("second", F.lit(0.0)) < margin, "choose").otherwise("answer")
    )
    return turns.withColumn("step", F.when(F.col("intent") == "greet", "greet").otherwise(step))


def parameter_grid(index: Index, query: DataFrame, targets: DataFrame, k1s: tuple, bs: tuple) -> DataFrame:
    """(k1, b, mrr10): BM25 under every pair of parameters; a document's scores under all of them are summed at once."""
    pairs = [(float(k1), float(b)) for k1 in k1s for b in bs]
    known = query.join(index.terms, "term").crossJoin(index.stats)  # stats: one row
    wanted = known.select("qid", "term", (F.col("qtf") * idf()).alias("w"), F.col("avgdl").alias("a"), F.lit(0.0).alias("base"), F.lit(0.0).alias("n_terms"))
    gain = lambda tf, dl, a: [tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / a)) for k1, b in pairs]
    best = target_ranks(index.held, wanted, targets, gain)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.lit(k1).alias("k1"), F.lit(b).alias("b")) for i, (k1, b) in enumerate(pairs)])).alias("x")
    every = targets.select("qid").distinct().select("qid", grid).select("qid", "x.*")
    rr = F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0)
    return every.join(best, ["g", "qid"], "left").groupBy("k1", "b").agg(F.round(F.avg(rr), 6).alias("mrr10"))


def selectively_reranked(run: DataFrame, new: DataFrame, unsure: DataFrame, depth: int) -> DataFrame:
    """(qid, doc_id, rank): reranked lists for the queries of ``unsure`` (qid), the others as they are."""
    from corpusmill.operators.fusion import rerank

    ask = unsure.select("qid").distinct()
    changed = rerank(run.join(ask, "qid", "left_semi"), new, depth)
    return run.join(ask, "qid", "left_anti").select("qid", "doc_id", "rank").unionByName(changed)


def analysed(queries: DataFrame, vocabulary: DataFrame, moods: dict[str, str], names: DataFrame) -> DataFrame:
    """One row a query with all that is known of it: clean and plain text, features, mood, named artist, quoted part."""
    features = query_features(queries, vocabulary)
    plain = strip_marks(clean(F.col("text")))
    moods_ = F.create_map(*[F.lit(x) for pair in moods.items() for x in pair])
    mood = F.try_element_at(F.filter(F.transform(F.split("plain", " "), lambda w: moods_[w]), lambda m: m.isNotNull()), F.lit(1))
    rows = queries.select("qid", "text", clean(F.col("text")).alias("cleaned"), plain.alias("plain"), F.nullif(F.regexp_extract("text", '["“]([^"”]+)["”]', 1), F.lit("")).alias("quoted"))
    listed = names.select(F.col("name")).distinct().agg(F.sort_array(F.collect_list("name")).alias("names"))  # a gazetteer: small by nature
    padded = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    held = F.filter("names", lambda n: padded.contains(F.concat(F.lit(" "), n, F.lit(" "))))
    longest = F.aggregate(held, F.lit(None).cast("string"), lambda a, n: F.when(a.isNull() | (F.length(n) > F.length(a)), n).otherwise(a))
    return rows.crossJoin(listed).select("qid", "cleaned", "plain", "quoted", mood.alias("mood"), longest.alias("artist")).join(features, "qid")
