"""Arrow batches of bounded size for Python stages that read whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of about ``most`` bytes; a lower bound of its own stays.

    Executor and worker hold a batch several times over, and 10,000 texts, Spark's bound, have any size. Every row
    still goes, a larger one in a batch of its own. Frames read the setting when they run, so it isn't put back.
    """
    now = spark.conf.get(SETTING, None)
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now else 0
    if not 0 < held <= most:
        spark.conf.set(SETTING, str(most))
