"""Mixing sources to target weights, with exact block quotas split down a tree of output shards.

Sizes are summed for each source, targets follow from the weights, and a source's target is a number
of whole passes over its documents plus a rest. Documents are dealt into blocks of about
``BLOCK_DOCS`` by hash; a source's blocks stand in a seeded order and the rest takes them in that order,
the block that passes the target in part. The blocks so drawn are the source's quota. A splitting
tree over the output shards halves all quotas at once with multivariate-hypergeometric draws, down to
exact quotas of every shard; each shard takes its stretch of each source's drawn blocks, disjoint
from those of the others, and orders its documents by a seeded hash. What is returned is this plan: which
shards take a document, and at which place of their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.prefix_sums import with_sum_before
from corpusmill.plans.durable import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_DOCS = 1024


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with weight and target.

    Sources by code point, null last, take ``weights`` in turn. They share ``share`` of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again. Every
    round is one aggregation of one row a source; the level of the targets is all the driver sees.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * (total or 0) / (weight or 1)
    cap = F.col("source_size") * most
    while True:
        over = cap < F.col("weight") * level
        held, free = weighed.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        above = (share * total - (held or 0)) / free
        if above <= level * (1 + 1e-15):
            break
        level = above
    return weighed.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact counts of each source in each shard; shard totals differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid, total = (lo + hi) // 2, int(own.sum())
        # shard s stands for draws total * s // n up to total * (s + 1) // n of its node
        left = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, left, method="marginals")
        todo += [(lo, mid, draw), (mid, hi, own - draw)]
    return out


def _stretches(shards: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values("place")  # one number a source
        counts = split_quotas(rows["quota"].to_numpy(), shards, seed)
        ends = np.cumsum(counts, axis=0)
        for s in range(shards):
            yield pd.DataFrame({"place": rows["place"], "shard": np.int32(s), "lo": ends[s] - counts[s], "hi": ends[s]})

    return run


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block of bounded size, in seeded order, each taken if it still fits."""
    rows = rows.sort_values(["turn", "key"])
    room, take = float(rows["room"].iloc[0]), []
    for size in rows["group_size"]:
        take.append(size <= room)
        room -= size if take[-1] else 0
    return rows.loc[take, ["place", "key"]]


def _key(c: str = "") -> Column:
    parts = [F.col("doc_id"), F.col("text"), F.col("source")]
    return F.xxhash64(*parts, *(p.isNull() for p in parts))


def mix_plan(docs: DataFrame, shards: int = 8, seed: int = 5, block_docs: int = BLOCK_DOCS, **targets) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, size, source_size, target, draws.

    size: words of the text (null: 0); draws: array of (epoch, shard, place) of each time that the mix takes
    the document, two at most; a shard is shuffled by sorting it by place, a seeded hash. A source's words taken stay below its target by less than the smallest
    document left of its last block, and never pass it. Rows that repeat doc_id, source and text are
    taken alike. Sources without a word have target 0. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"
    ).select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("key"))
    narrow = scratch.save(narrow, "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = with_targets(sources, **targets).withColumn("place", order)
    sources = sources.withColumn("blocks", F.ceil(F.col("docs") / block_docs))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("passes", passes.cast("long"))
    sources = scratch.save(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
    of_source = ["place", "blocks", "passes", "rest", "source_size", "target"]
    dealt = narrow.join(sources.select("source", *of_source), narrow["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "key", *of_source,
        F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")).cast("long").alias("block"),
    )
    dealt = scratch.save(dealt, "dealt")
    # empty blocks have no documents to draw: the blocks in use are numbered by a seeded order
    blocks = scratch.save(dealt.groupBy(*of_source, "block").agg(F.sum("size").alias("words")), "block_sums")
    stride = F.greatest(F.floor(F.col("blocks") * 0.6180339887), F.lit(1)).cast("long")
    turned = F.pmod(F.col("block") * _coprime(stride, F.col("blocks")) + F.xxhash64(F.lit(seed), "place") % 1_000_003, F.col("blocks"))
    summed = with_sum_before(blocks.withColumn("turn", turned), ["place"], "turn", F.col("words"), "before")
    # a block without a word takes no room: where no rest is left it isn't drawn
    room = F.col("before") < F.col("rest")
    whole = room & (F.col("before") + F.col("words") <= F.col("rest"))
    partly = room & ~whole
    summed = scratch.save(summed.withColumn("whole", whole).withColumn("partly", partly), "blocks")
    drawn = F.when(F.col("whole") | F.col("partly"), 1).otherwise(0)
    ranked = with_sum_before(summed, ["place"], "turn", F.lit(1), "nth")
    quotas = ranked.groupBy("place").agg(
        (F.max("passes") * F.count("*") + F.sum(drawn)).alias("quota"), F.count("*").alias("used")
    )
    stretches = scratch.save(
        quotas.select("place", "quota").repartition(1).mapInPandas(_stretches(shards, seed), "place int, shard int, lo long, hi long")
        .groupBy("place").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("stretches")), "stretches"
    )
    epochs = F.sequence(F.lit(0).cast("long"), F.col("passes") + drawn - 1)
    shard_of = lambda n: F.filter("stretches", lambda s: (s["lo"] <= n) & (n < s["hi"]))[0]["shard"]
    with_draws = (
        ranked.join(quotas, "place").join(stretches, "place")
        .withColumn("draws", F.when(F.col("passes") + drawn > 0, F.transform(
            epochs, lambda e: F.struct(e.cast("int").alias("epoch"), shard_of(e * F.col("used") + F.col("nth")).alias("shard"))
        )).otherwise(F.array().cast("array<struct<epoch:int,shard:int>>")))
        .select("place", "block", "partly", "before", "draws")
    )
    with_draws = scratch.save(with_draws, "draws")
    # the block in which a target lies: of its documents those that fit
    open_rows = dealt.join(with_draws.where("partly").select("place", "block", "before"), ["place", "block"])
    groups = open_rows.groupBy("place", "key").agg(
        F.sum("size").alias("group_size"), F.max(F.col("rest") - F.col("before")).alias("room")
    )
    groups = groups.withColumn("turn", F.xxhash64(F.lit(seed), F.lit("fill"), "key"))
    fits = groups.groupBy("place").applyInPandas(_fill, "place int, key long").withColumn("fits", F.lit(True))
    placed = dealt.join(with_draws, ["place", "block"]).join(fits, ["place", "key"], "left")
    draws = F.when(F.col("partly") & F.col("fits").isNull(), F.slice("draws", 1, F.greatest(F.size("draws") - 1, F.lit(0))))
    with_place = F.transform(draws.otherwise(F.col("draws")), lambda d: d.withField("place", F.xxhash64(F.lit(seed), F.lit("order"), "key", d["epoch"])))
    return placed.select("doc_id", "key", "size", "source_size", "target", with_place.alias("draws"))


def _coprime(stride: Column, n: Column) -> Column:
    """The first number from ``stride`` on that shares no factor with ``n``."""
    def gcd(x: Column) -> Column:
        pair = F.struct(x.alias("a"), n.alias("b"))
        step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(90)), pair, step)["a"]

    tries = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: stride + k)
    return F.filter(tries, lambda x: gcd(x) == 1)[0]


def mix(docs: DataFrame, shards: int = 8, seed: int = 5, **options) -> DataFrame:
    """Every row that the mix takes, once for each time: the columns of ``docs``, epoch_, shard_, order_.

    order_ is the seeded place among the rows of a shard: sort a shard by it to shuffle it. Columns of
    ``docs`` pass through, whatever their names, but for epoch_, shard_ and order_, which it must not have.
    """
    plan = mix_plan(docs, shards, seed, **options).where(F.size("draws") > 0)
    taken = plan.groupBy("key").agg(F.first("draws").alias("draws")).select("key", "draws")
    names = [f"c{k}" for k in range(len(docs.columns))]  # no name can clash inside
    own = docs.select("*", _key().alias("key_")).toDF(*names, "key")
    out = own.join(taken, "key").withColumn("draw", F.explode("draws"))
    added = [F.col("draw.epoch").alias("epoch_"), F.col("draw.shard").alias("shard_"), F.col("draw.place").alias("order_")]
    return out.select(*names, *added).toDF(*docs.columns, "epoch_", "shard_", "order_")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix` so that files written from them hold whole stretches of one shard's order."""
    return mixed.repartitionByRange("shard_", "order_").sortWithinPartitions("shard_", "order_")
