"""Percentiles with bounded relative error from signed logarithmic buckets.

A value x falls in bucket ceil(log(|x|) / log(gamma)) of its sign, zero in a
bucket of its own; gamma = (1 + a) / (1 - a). A bucket's middle differs from
every value in it by a share of at most ``a``. Sketches are plain rows
(group, sign, bucket, n), so those of days or partitions merge by adding up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the relative error of a percentile.
ALPHA = 0.01
#: Beyond any bucket number of a double at any sensible ALPHA.
_FAR = 10_000_000


def once(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Exact copies of a row (same ``row_id``) once; rows without an id all stay."""
    thin = df.select(row_id, *cols)
    known = thin.filter(F.col(row_id).isNotNull()).dropDuplicates([row_id])
    if not df.schema[row_id].nullable:
        return known
    return known.unionByName(thin.filter(F.col(row_id).isNull()))


def sketch(df: DataFrame, value: str, groups: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Bucket counts: groups, sgn, bucket, n.

    Counts are added before the shuffle, so no group is too hot and a task
    never holds more than the buckets. Null, NaN and infinite values are left
    out; a null group is a group.
    """
    width = math.log((1 + alpha) / (1 - alpha))
    x = F.col(value).cast("double")
    sgn = F.signum(x).cast("int")
    bucket = F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.lit(width)).cast("int"))
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    keep = df.filter(fine).select(*groups, sgn.alias("sgn"), bucket.alias("bucket"))
    return keep.groupBy(*groups, "sgn", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add up sketches of parts to those of coarser groups; exact, in any order."""
    return sketches.groupBy(*groups, "sgn", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], shares: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """One row per group: n and the named percentiles.

    The percentile p is the estimate of the value of rank floor(p * (n - 1)),
    off by at most the share ``alpha`` of that value; zeros come out exactly.
    """
    gamma = (1 + alpha) / (1 - alpha)
    place = F.col("sgn") * (F.col("bucket") + F.lit(_FAR))
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = sketches.withColumn("place", place)
    x = x.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    mid = F.col("sgn") * F.lit(2.0) / F.lit(gamma + 1) * F.pow(F.lit(gamma), F.col("bucket"))
    x = x.withColumn("mid", mid)
    picks = [
        F.min_by("mid", F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("place"))).alias(name)
        for name, p in shares.items()
    ]
    return x.groupBy(*groups).agg(F.max("total").alias("n"), *picks)
