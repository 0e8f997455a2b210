"""Windowed aggregation of event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.durable import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    plain = spark.read.parquet(path).inputFiles()
    if len(plain) == 1 and plain[0].rstrip("/").endswith("/" + name):  # a file: its folder with a filter on the name
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants: wall-clock times are read in the session's time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """(window, by..., n): tumbling, or sliding, counts of (ts, ...); what is later than ``late`` is dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events).withWatermark("ts", late).groupBy(window, *by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(user, F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its source is read, and give what it wrote.

    The result goes to files in the shared folder, batch by batch under the batch's number, so a batch
    that is run again replaces itself; in complete mode the last batch is the result.
    """
    root = f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out").drop("batch")


def streamed_counts(spark: SparkSession, path: str) -> DataFrame:
    return run_to_table(windowed_counts(read_stream(spark, path)), "complete")
