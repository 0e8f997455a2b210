"""Dealing out a scan that has fewer splits than the cluster has cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its scan has fewer.

    Work on texts (tokenising, shingling) costs far more than moving them once, and one file with one row
    group is one task otherwise. A large table has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
