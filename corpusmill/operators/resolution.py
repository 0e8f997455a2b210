"""Answers resolved to catalogue entries, and measures of generated text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import counted, ngrams, plain_tokens
from corpusmill.operators.understanding import gazetteer_matches
from corpusmill.plans.batches import bound_batches
from corpusmill.plans.durable import Scratch

ACCEPT, MATCH, MARGIN = 0.9, 0.6, 0.1


def resolve_answers(answers: DataFrame, catalogue: DataFrame, most_words: int = 6) -> DataFrame:
    """(id, cluster, confidence, decision) of (id, text) against (cluster, title, artist), titles and artists normalised.

    A title found in the text is evidence: with its artist in the text 0.6 + 0.4 * (0.5 + 0.5 * specificity), without
    0.85 * (0.6 + 0.4 * specificity), specificity being a third of its words, 1 at most. accept: confidence 0.9 or
    more and 0.1 ahead of any other cluster; ambiguous: accepted in confidence, not in margin; review: 0.6 or more.
    """
    plain = F.array_join(plain_tokens(F.col("text")), " ")
    texts = answers.select(F.col("id").alias("doc_id"), plain.alias("text"))
    titles = catalogue.select(F.col("title").alias("name"), F.lit("title").alias("kind")).distinct()
    found = gazetteer_matches(texts, titles, most_words).select("doc_id", F.col("name").alias("title")).distinct()
    met = found.join(catalogue, "title").join(texts, "doc_id")
    named = (F.col("artist") != "") & F.concat(F.lit(" "), F.col("text"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("artist"), F.lit(" ")))
    spec = F.least(F.lit(1.0), F.size(F.split("title", " ")) / 3)
    confidence = F.when(named, 0.6 + 0.4 * (0.5 + 0.5 * spec)).otherwise(0.85 * (0.6 + 0.4 * spec))
    best = met.groupBy(F.col("doc_id").alias("id"), "cluster").agg(F.round(F.max(confidence), 6).alias("confidence"))
    order = Window.partitionBy("id").orderBy(F.desc("confidence"), "cluster")
    ranked = best.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("confidence").over(order)).where("place = 1")
    clear = F.col("confidence") - F.coalesce("second", F.lit(0.0)) >= MARGIN - 1e-9
    decision = (
        F.when((F.col("confidence") >= ACCEPT) & clear, "accept").when(F.col("confidence") >= ACCEPT, "ambiguous")
        .when(F.col("confidence") >= MATCH, "review").otherwise("reject")
    )
    return ranked.select("id", "cluster", "confidence", decision.alias("decision"))


def bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """(bleu, precision of each order, brevity) of a corpus of (id, said, truth), arrays of words; 0 if an order has no match."""
    # the k-th time that a run of words stands in an array is a word of its own, so matches are an intersection in the row
    tagged = lambda r: F.transform(F.sequence(F.lit(1).cast("long"), r["tf"]), lambda k: F.when(k == 1, r["term"]).otherwise(F.concat_ws(" ", r["term"], k.cast("string"))))
    times = lambda g: F.flatten(F.transform(counted(g), tagged))
    pairs = pairs.select(F.explode(F.array(F.struct("said", "truth"))).alias("x")).select("x.said", "x.truth")  # or texts would be analysed anew in each expression
    sums = [F.sum(F.size("said")).alias("c"), F.sum(F.size("truth")).alias("r")]
    for n in range(1, order + 1):
        said, truth = (ngrams(F.col(c), n, " ") for c in ("said", "truth"))
        sums += [F.sum(F.size(F.array_intersect(times(said), times(truth)))).alias(f"m{n}"), F.sum(F.greatest(F.size("said") - (n - 1), F.lit(0))).alias(f"t{n}")]
    out = pairs.agg(*sums)
    p = [F.coalesce(F.try_divide(f"m{n}", f"t{n}"), F.lit(0.0)) for n in range(1, order + 1)]
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest("c", F.lit(1))))
    logs = sum((F.log(x) for x in p), F.lit(0.0)) / order
    score = F.when(F.least(*p) > 0, brevity * F.exp(logs)).otherwise(0.0)
    return out.select(F.round(score, 6).alias("bleu"), *[F.round(x, 6).alias(f"p{n}") for n, x in enumerate(p, 1)], F.round(brevity, 6).alias("brevity"))


def distinct_n(docs: DataFrame, orders: tuple = (1, 2, 3)) -> DataFrame:
    """(n, grams, distinct, share): how varied texts are, by n-grams of plain words."""
    words = plain_tokens(F.col("text"))
    grams = docs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.transform(ngrams(words, n, " "), lambda g: F.xxhash64(g)).alias("g")) for n in orders])).alias("x"))
    rows = grams.select("x.n", F.explode("x.g").alias("g"))
    return rows.groupBy("n").agg(F.count("*").alias("grams"), F.count_distinct("g").alias("distinct")).withColumn("share", F.round(F.col("distinct") / F.col("grams"), 6))


def blend_with_rank(run: DataFrame, ranks: DataFrame, weight: float = 0.2) -> DataFrame:
    """(qid, doc_id, score): (1 - weight) * score / best + weight * rank percentile of (doc_id, rank); unranked: 0."""
    order = Window.orderBy("rank", "doc_id")  # one row a ranked node
    n = ranks.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    share = ranks.withColumn("k", F.row_number().over(order) - 1).crossJoin(n).select("doc_id", (F.col("k") / F.col("n")).alias("share"))
    best = F.max("score").over(Window.partitionBy("qid"))
    return run.withColumn("own", F.col("score") / best).join(share, "doc_id", "left").select(
        "qid", "doc_id", ((1 - weight) * F.col("own") + weight * F.coalesce("share", F.lit(0.0))).alias("score")
    )


def latent_vectors(docs: DataFrame, k: int = 50, features: int = 4096, terms=None) -> tuple[DataFrame, object]:
    """((doc_id, v), fold): documents in ``k`` latent dimensions of hashed tf-idf, and a function that folds texts in.

    Texts are analysed once. One pass over the written vectors sums their products where they lie; what the driver holds
    is features x features.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    analyse = plain_tokens(F.col("text")) if terms is None else terms
    tf = HashingTF(numFeatures=features, inputCol="terms", outputCol="tf")
    scratch = Scratch(docs.sparkSession, "latent")
    terms_of = scratch.save(tf.transform(docs.select("doc_id", analyse.alias("terms"))).select("doc_id", "tf"), "tf")
    idf = IDF(minDocFreq=2, inputCol="tf", outputCol="raw").fit(terms_of)
    norm = Normalizer(inputCol="raw", outputCol="x")
    weighed = scratch.save(norm.transform(idf.transform(terms_of)).select("doc_id", "x"), "weighed")
    values, vectors = np.linalg.eigh(_products(weighed.select(vector_to_array("x").alias("x")), features))
    order = np.argsort(-values, kind="stable")[: min(k, features)]
    basis = vectors[:, order[values[order] > 1e-15 * max(values.max(), 0)]]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def project(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) @ basis
        return pd.Series(list((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)))

    shown = lambda rows: rows.select("doc_id", project(vector_to_array("x")).alias("v"))

    def fold(rows: DataFrame) -> DataFrame:
        return shown(norm.transform(idf.transform(tf.transform(rows.select("doc_id", analyse.alias("terms"))))))

    return shown(weighed), fold


def _products(rows: DataFrame, n: int) -> np.ndarray:
    """Sum of x^T x over rows (x), arrays of ``n`` numbers: each task sums its own, and tasks are added pair by pair."""
    bound_batches(rows.sparkSession)

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = rows.mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r["m"])).reshape(n, n))
    return parts.treeReduce(lambda a, b: a + b, 3)
