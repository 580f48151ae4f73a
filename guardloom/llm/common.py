"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound Python work enough partitions.

    A table in one small file is one task; only then it is worth moving the
    rows. A table of many files is left as it is read.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
