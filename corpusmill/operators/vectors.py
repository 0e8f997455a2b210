"""Nearest neighbours by cosine over ARRAY<FLOAT> columns.

Blocks of queries meet chunks of vectors, each pair of them once, as two matrices in one group of bounded size.
Only the best k of each group leave it, so what is shuffled grows with groups and not with pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors that meet in one group at once.
BLOCK, CHUNK = 1024, 8192


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(x, dtype=np.float64) for x in rows])
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _scores(k: int | None, group: str | None, least: float = -np.inf):
    """Of each query's vectors in a cell the first ``k``, or all with a score of ``least`` or more."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        key = group or "vec_id"
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), key: vectors[key].iloc[:0], "score": pd.Series(dtype="float64")})]
        if len(queries) and len(vectors):
            ids, own, keys = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), vectors[key].to_numpy()
            scores = np.round(_unit(queries["asked"]) @ _unit(vectors["embedding"]).T, 6)
            scores[ids[:, None] == own[None, :]] = -np.inf
            for q, row in zip(ids, scores, strict=True):
                at = np.flatnonzero(np.isfinite(row) & (row >= least))
                best = at[np.lexsort((keys[at], -row[at]))]
                if group:  # the first of each group
                    best = best[np.sort(np.unique(keys[best], return_index=True)[1])]
                best = best[:k]
                out.append(pd.DataFrame({"query_id": q, key: keys[best], "score": row[best]}))
        return pd.concat([x for x in out if len(x)] or out)

    return run


def _met(vectors: DataFrame, queries: DataFrame, scores, schema: str) -> DataFrame:
    """Blocks of queries meet chunks of vectors, each pair once: a group holds one block and one chunk."""
    blocks, chunks = (max(1, -(-df.count() // n)) for df, n in ((queries, BLOCK), (vectors, CHUNK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select(own(blocks).alias("block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), every(chunks).alias("chunk"))
    v = vectors.select("*", own(chunks).alias("chunk"), every(blocks).alias("block"))
    return q.groupBy("block", "chunk").cogroup(v.groupBy("block", "chunk")).applyInPandas(scores, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors with the largest cosine, itself left out; ties to smaller ids."""
    found = _met(vectors.select("vec_id", "embedding"), queries, _scores(k, None), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, vec_id, score): all vectors with a cosine of ``least`` or more, itself left out."""
    return _met(vectors.select("vec_id", "embedding"), queries, _scores(None, None, least), "query_id long, vec_id long, score double")


def best_of_group(vectors: DataFrame, group: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, group, score, rank): groups by the largest cosine of a member, ties to the smaller group.

    A group that is among the first k is so in the cell that holds its best member: cells give k groups each.
    """
    kind = dict(vectors.dtypes)[group]
    found = _met(vectors.select("vec_id", "embedding", group), queries, _scores(k, group), f"query_id long, {group} {kind}, score double")
    best = found.groupBy("query_id", group).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), group)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
