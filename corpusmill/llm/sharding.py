"""Sharding: a two-pass external shuffle of all records.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash; rows equal in every
column, where they are many, are numbered first and so scattered too. Pass two
gathers each bucket, shuffles it with a seeded Fisher-Yates pass (Spark's ``shuffle``) and numbers its
rows behind those of the buckets before it. The numbers are one random order of all rows; shards are
equal stretches of it, so their row counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.prefix_sums import with_sum_before
from corpusmill.plans.durable import Scratch

LAW = "rows"
#: Rows and bytes of a bucket on average; the one that is reached first sets the number of buckets.
BUCKET_ROWS, BUCKET_BYTES = 8192, 16 << 20


def _with_copies(records: DataFrame, size: str, most_rows: int, most_bytes: int, scratch: Scratch, stretch: int = 1024) -> DataFrame:
    """(record, copy): rows with a number that tells equal rows apart where they are too many for one bucket.

    Rows are counted by a hash of all columns. Those of a hash that would fill a bucket are counted by value, with
    map-side combine, and written out again in stretches, so that no task holds or makes all of them.
    """
    columns = [F.col(f"`{c}`") for c in records.columns]
    mark = F.xxhash64(*columns, *(c.isNull() for c in columns))
    many = (F.col("n") > most_rows) | (F.col("bytes") > most_bytes)
    counted = records.select(mark.alias("mark_"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("b"))
    hot = counted.groupBy("mark_").agg(F.count("*").alias("n"), F.sum("b").alias("bytes")).where(many & (F.col("n") > 1)).select("mark_")
    hot = scratch.save(hot, "hot")
    single = F.lit(0).cast("long").alias("copy")
    record = F.struct(*columns).alias("record")
    if hot.isEmpty():
        return records.select(record, single)
    marked = records.select(record, mark.alias("mark_"))
    equal = marked.join(hot, "mark_", "left_semi").groupBy("mark_", "record").agg(F.count("*").alias("n"))
    parts = equal.select("mark_", "record", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {stretch})")).alias("part"))
    spread = parts.repartition(F.xxhash64("mark_", "part"))
    copies = spread.select("record", F.explode(F.expr(f"sequence(part * {stretch}, least((part + 1) * {stretch}, n) - 1)")).alias("copy"))
    return marked.join(hot, "mark_", "left_anti").select("record", single).unionByName(copies)


def shuffle_into_shards(
    records: DataFrame,
    size: str = "size",
    shards: int = 8,
    seed: int = 11,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``records`` with position (its place in the shuffled order), shard and slot (gapless from 0).

    ``size`` names the column with the bytes of a record (null: 0). Records are dealt by a hash of all
    their columns, so a value that many rows share doesn't fill one bucket; rows that are equal in every column
    are numbered first where they would fill one. Every row gets a slot, rows with nulls and repeated rows
    included. An empty table gives an empty result. The order depends on the rows, ``seed`` and the number
    of partitions that the buckets are dealt to.
    All columns must be sortable (no maps); their names must not be position, shard or slot.
    """
    total = records.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("bytes")).first()
    n, n_bytes = total["n"], total["bytes"] or 0
    buckets = max(1, -(-n // bucket_rows), -(-n_bytes // bucket_bytes))
    scratch = Scratch(records.sparkSession, "shards")
    own = _with_copies(records, size, max(1, bucket_rows // 8), bucket_bytes // 8, scratch)
    fields = [F.col("record").getField(c) for c in records.columns]
    deal = F.pmod(F.xxhash64(F.lit(seed), F.col("copy"), *fields, *(c.isNull() for c in fields)), F.lit(buckets))
    # a stated count is not changed at run time: buckets keep their tasks, and so their shuffles
    scattered = (
        own.select(deal.cast("long").alias("bucket"), "record").repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket")
    )
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("rows"))
    mixed = gathered.select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = scratch.save(mixed.select("bucket", F.posexplode("rows").alias("at", "record")), "buckets")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("whole", F.lit(0))
    starts = with_sum_before(sizes, ["whole"], "bucket", F.col("n"), "start").select("bucket", "start")
    out = placed.join(starts, "bucket").withColumn("position", F.col("start") + F.col("at"))
    # rows of shard s stand from ceil(s * n / shards) on
    out = out.withColumn("shard", F.expr(f"cast(position * {shards}L div {max(n, 1)}L as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return out.select("record.*", "position", "shard", (F.col("position") - first).alias("slot"))


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as Parquet, one folder a shard, rows in the order of their slots."""
    out = shuffle_into_shards(records, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
