"""Exact top-k by inner product, retrieved from buckets of vectors of near equal length.

Of equal vectors only those with the k + 1 smallest ids can be in an answer (a query leaves out its own id),
so the others go first. The rest is range-partitioned by falling length into buckets. A first round takes each
query's best from the longest bucket; its k-th best, score and id, is a threshold. In a bucket whose longest
vector has length b, only vectors with a cosine of threshold / (query length * b) or more can still enter. Buckets
that need a cosine above one are never sent the query, and a bucket goes only to blocks of queries that
reach it; blocks hold queries of near equal length. Inside a bucket, a high cosine threshold prunes by coordinates
(the query's largest coordinates bound those of a candidate), a low one by length alone (candidates stand
in order of length); what is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.durable import Scratch

TOP = 20
#: Rows of a bucket of candidates and of a block of queries.
BUCKET_ROWS, QUERY_ROWS = 8192, 2048
#: Local cosine threshold from which coordinates prune, and how many coordinates of a query do.
COORDINATE_FROM, FOCUS = 0.6, 4


def scaled(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as a double; rows that take no part are left out.

    Null ids, null vectors and vectors with a null or non-finite component are left out; rows that repeat an
    id stay.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where("vec_id is not null and embedding is not null").where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    width = max((len(x) for x in column), default=0)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where every partial sum is exact."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1)
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _candidates(q: np.ndarray, q_len: float, need: float, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray | slice:
    """Positions in a bucket (sorted by falling length) that can score ``need`` or more."""
    longest = lengths[0]
    if not np.isfinite(need) or need <= 0 or q_len == 0 or longest == 0:
        return slice(None)
    slack = 1 - 1e-9  # rounding must not lose a candidate
    by_length = int(np.searchsorted(-lengths, -(need / q_len) * slack, side="right"))
    cosine = min(need / (q_len * longest) * slack, 1.0)
    if cosine < COORDINATE_FROM or by_length == 0:
        return slice(0, by_length)
    # angles to an axis differ by at most acos(t) between unit vectors with q.c >= t
    own = q / q_len
    focus = np.argsort(-np.abs(own))[:FOCUS]
    stay = np.ones(by_length, dtype=bool)
    for f in focus:
        spread = np.sqrt(max(0.0, (1 - own[f] ** 2) * (1 - cosine**2))) + 1e-9
        low = -1.0 if own[f] <= -cosine else own[f] * cosine - spread
        high = 1.0 if own[f] >= cosine else own[f] * cosine + spread
        stay &= (unit[:by_length, f] >= low) & (unit[:by_length, f] <= high)
    return np.flatnonzero(stay)


def _best(k: int):
    def run(queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(bucket):
            return empty
        c = _matrix(bucket["v"])
        lengths = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        c, lengths, ids = c[order], lengths[order], bucket["vec_id"].to_numpy()[order]
        unit = c / np.maximum(lengths, 1e-300)[:, None]
        q = _matrix(queries["v"])
        if q.shape[1] < c.shape[1]:
            q = np.pad(q, ((0, 0), (0, c.shape[1] - q.shape[1])))
        q_ids, need, need_id = queries["vec_id"].to_numpy(), queries["need"].to_numpy(dtype=np.float64), queries["need_id"].to_numpy()
        q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        found = [_candidates(q[i, : c.shape[1]], q_len[i], need[i], unit, lengths) for i in range(len(q))]
        wide = [i for i, x in enumerate(found) if isinstance(x, slice)]
        out = []

        def keep(i: int, at: np.ndarray | slice, scores: np.ndarray) -> None:
            own = ids[at]
            fit = own != q_ids[i]
            if np.isfinite(need[i]):  # as good as the k-th best so far, and of equals those with smaller ids
                fit &= (scores > need[i]) | ((scores == need[i]) & (own < need_id[i]))
            own, scores = own[fit], scores[fit]
            if len(own) > k:
                last = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= last  # ties at the end too
                own, scores = own[near], scores[near]
                best = np.lexsort((own, -scores))[:k]
                own, scores = own[best], scores[best]
            out.append((np.full(len(own), q_ids[i]), own, scores))

        for at in range(0, len(wide), 128):
            part = wide[at : at + 128]
            stop = max((len(c) if found[i].stop is None else found[i].stop) for i in part)
            for i, scores in zip(part, _products(q[part], c[:stop]), strict=True):
                n = len(c) if found[i].stop is None else found[i].stop
                keep(i, slice(0, n), scores[:n])
        for i, x in enumerate(found):
            if not isinstance(x, slice) and len(x):
                keep(i, x, _products(q[i : i + 1], c[x])[0])
        if not out:
            return empty
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


_FOUND = "query_id long, vec_id long, score long"
_SENT = "vec_id long, v array<bigint>, block int, need double, need_id long, bucket int"


def _reached(bounds: np.ndarray, numbers: np.ndarray):
    """Each row once for every bucket that it can still get something from; bounds rise, the shortest bucket first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, need = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "need"))
            least = np.where(need > 0, need / np.maximum(length, 1e-300) * (1 - 1e-9), -np.inf)
            start = np.searchsorted(bounds, least)
            counts = len(bounds) - start
            row = np.repeat(np.arange(len(start)), counts)
            at = np.repeat(start, counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            for lo in range(0, len(row), 4096):
                part = pa.array(row[lo : lo + 4096])
                columns = [b.column(b.schema.get_field_index(c)).take(part) for c in ("vec_id", "v", "block", "need", "need_id")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(numbers[at[lo : lo + 4096]], pa.int32())], names=["vec_id", "v", "block", "need", "need_id", "bucket"]
                )

    return run


def entrants(vectors: DataFrame, k: int) -> DataFrame:
    """The rows of (vec_id, v) that can be in some query's answer: of equal vectors those with the k + 1 smallest ids.

    Equal rows are kept ``k`` times at most.
    """
    counted = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("v"))
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = counted.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")).drop("copy")


def _in_stretches(rows: DataFrame, count: int, name: str, scratch: Scratch, table: str) -> DataFrame:
    """``rows`` with the number of their stretch, of ``count``, in the order of falling length.

    A session may deal rows to more partitions than asked for; neighbouring ones are one stretch then.
    """
    dealt = rows.repartitionByRange(count, F.desc("length"), "vec_id").withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, table)
    parts = max((dealt.agg(F.max("part")).first()[0] or 0) + 1, count)
    return dealt.withColumn(name, F.floor(F.col("part") * count / parts).cast("int")).drop("part")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products, ties to smaller ids.

    ``vectors`` and ``queries`` are (vec_id, v array<bigint>). Candidates are all rows of another id than the
    query's; rows that repeat an id are candidates of their own, and query rows that repeat an id are
    answered together. With fewer than ``k`` candidates all are returned. Missing components of shorter vectors
    count as zero. Either table may be empty: the result then is. The driver holds one number a bucket.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    pool = scratch.save(entrants(vectors, k).withColumn("length", F.sqrt(squares)), "pool")
    buckets, blocks = max(1, -(-pool.count() // bucket_rows)), max(1, -(-queries.count() // query_rows))
    bucketed = _in_stretches(pool, buckets, "bucket", scratch, "vectors")
    scratch.drop("pool")
    asked = _in_stretches(queries.withColumn("length", F.sqrt(squares)), blocks, "block", scratch, "queries")
    longest = {r["bucket"]: r["b"] for r in bucketed.groupBy("bucket").agg(F.max("length").alias("b")).collect()}
    last_block = asked.agg(F.max("block")).first()[0]
    if not longest or last_block is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = sorted(longest)

    def searched(sent: DataFrame, among: DataFrame) -> DataFrame:
        """Both sides come with cell columns (block, bucket)."""
        return sent.groupBy("block", "bucket").cogroup(among.groupBy("block", "bucket")).applyInPandas(_best(k), _FOUND)

    nothing = [F.lit(float("-inf")).alias("need"), F.lit(0).cast("long").alias("need_id")]
    every_block = F.explode(F.sequence(F.lit(0), F.lit(last_block))).alias("block")
    first = scratch.save(
        searched(
            asked.select("vec_id", "v", "block", F.lit(order[0]).alias("bucket"), *nothing),
            bucketed.where(F.col("bucket") == order[0]).select("vec_id", "v", "bucket", every_block),
        ), "first"
    )
    found = first
    if len(order) > 1:
        worst = first.groupBy("query_id").agg(F.min(F.struct("score", (-F.col("vec_id")).alias("late"))).alias("w"), F.count("*").alias("n"))
        full = F.col("n") >= k
        needs = [F.when(full, F.col("w.score").cast("double")).otherwise(float("-inf")).alias("need"), F.when(full, -F.col("w.late")).otherwise(0).alias("need_id")]
        rest = order[:0:-1]  # shortest first
        known = asked.join(worst, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "block", "length", *needs)
        sent = scratch.save(known.mapInArrow(_reached(np.array([longest[b] for b in rest]), np.array(rest)), _SENT), "sent")
        asks = sent.select(F.col("block").alias("asks"), "bucket").distinct()
        cells = bucketed.join(asks, "bucket").select("vec_id", "v", "bucket", F.col("asks").alias("block"))
        found = first.unionByName(searched(sent, cells))
    # each query has at most k rows a bucket here
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
