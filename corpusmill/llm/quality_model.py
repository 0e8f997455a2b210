"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Texts are cut into runs of letters and digits and runs of other signs; unigrams and bigrams of those
are hashed into a fixed number of weights. Features are made on the executors. The model is fitted
on the driver from a bounded, hash-chosen sample of labelled rows (``MAX_ROWS``, ``MAX_VALUES``), each with all
its features, row by row, and sent back as one array of fixed size; each text is then scored as a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.batches import bound_batches
from corpusmill.plans.durable import Scratch

#: Weights; a power of two.
DIMENSIONS = 1 << 18
#: Bound of the sample that the model is fitted on: rows, and feature values (8 bytes each) of all its rows together.
MAX_ROWS, MAX_VALUES = 6000, 12_000_000
#: Chosen by the loss on teaching rows with remainder 1, fitted on those with remainders 2 to 4.
EPOCHS, ALPHA, BETA, L1, L2 = 12, 2.0, 1.0, 0.01, 0.001
THRESHOLD = 0.3

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = 1  # the bigram of a token with itself, whichever token it is


def _token_hash(token: bytes) -> int:
    h = 0xCBF29CE484222325
    for byte in token:  # FNV-1a
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


class Featurizer:
    """Sparse features of UTF-8 texts; hashes of tokens seen before are kept up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS, keep: int = 200_000):
        self.shift, self.keep, self.known = np.uint64(64 - (dimensions.bit_length() - 1)), keep, {}

    def __call__(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values: square roots of shares, so the norm is 1."""
        tokens = _TOKEN.findall(raw) if raw else []
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = _token_hash(t)
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        pairs = (h[:-1] * np.uint64(3) + (h[1:] << np.uint64(7)) + (h[1:] >> np.uint64(57))) ^ np.uint64(0x5851F42D4C957F2D)
        pairs[h[:-1] == h[1:]] = _REPEAT
        slots = (np.concatenate([h, pairs]) * _MULTIPLIER) >> self.shift
        index, counts = np.unique(slots.astype(np.int64), return_counts=True)
        return index, np.sqrt(counts / len(slots))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, after ``EPOCHS`` passes over (features, values, label) in a seeded order.

    Per-coordinate follow-the-regularised-leader: z holds adjusted gradient sums, n squared gradient
    sums; a weight is zero until its z exceeds the L1 penalty. No rows: all weights zero.
    """
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            index, values, label = rows[k]
            at, x = np.append(index, dimensions), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """True for rows that never teach: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _feature_batches(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(dimensions)
        for b in batches:
            got = [features(x.as_py()) for x in b.column(2)]
            blobs = [pa.array([c[k].astype(t).tobytes() for c in got], pa.binary()) for k, t in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *blobs], names=["doc_id", "label", "index", "value"])

    return run


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, dimensions: int = DIMENSIONS, max_values: int = MAX_VALUES
) -> np.ndarray:
    """Weights learned from the rows of ``docs`` that ``labels`` (doc_id, quality) marks 0 or 1.

    Held-out ids, null labels and null ids don't teach; of several labels of an id the smallest
    counts. At most ``max_rows`` rows are used, those with the least hash, and of those the first whose
    features are not more than ``max_values`` together; no row is cut.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
    )
    marked = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # max_rows rows of 12 bytes
        .select("doc_id", "label", "raw")
        .mapInArrow(_feature_batches(dimensions), "doc_id long, label int, index binary, value binary")
    )
    marked = scratch.save(marked.withColumn("n", F.expr("octet_length(index) div 4")), "features")
    order = [F.xxhash64("doc_id"), "doc_id", "n", F.xxhash64("index", "value")]
    upto = F.sum("n").over(Window.orderBy("h", "doc_id", "n", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = marked.select(order[0].alias("h"), "doc_id", "n", order[3].alias("x")).orderBy("h", "doc_id", "n", "x").limit(max_rows)
    size = first.withColumn("upto", upto).where(F.col("upto") <= max_values).count()  # a window of max_rows rows
    rows = marked.orderBy(*order).limit(size).select("label", "index", "value").collect() if size else []
    return fit_ftrl([(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4"), r[0]) for r in rows], dimensions)


def _score_batches(weights: np.ndarray, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(len(weights) - 1)
        for b in batches:
            sums = np.array([float(weights[i] @ v) if len(i) else 0.0 for i, v in map(features, (x.as_py() for x in b.column(position)))])
            scores = 1 / (1 + np.exp(-np.clip(sums + float(weights[-1]), -35, 35)))
            kept = [b.column(i) for i in range(b.num_columns) if i != position]
            names = [x for i, x in enumerate(b.schema.names) if i != position]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``, from its whole text alone.

    Null and empty texts get the score of the bias. A model without rows scores everything 0.5.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return narrow.mapInArrow(_score_batches(weights, 1), "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; columns as in ``docs``, whatever their names."""
    bound_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name can clash inside
    plain = docs.toDF(*names)
    at = docs.columns.index("text")
    schema = ", ".join([*(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)), "score double"])
    scored = plain.withColumn("raw", F.col(names[at]).cast("binary")).mapInArrow(
        _score_batches(weights, len(names)), schema
    )
    return scored.where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
