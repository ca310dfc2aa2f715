"""Ranks within groups of any size, with DataFrame functions only.

A window over a whole group would put the group into one task.  Here a group's rows fall
into buckets of its order; buckets are counted, the counts are summed up (a few rows for a
group), and a row's rank is its bucket's start plus its place in the bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bucket_count(n: int) -> int:
    """Buckets for ``n`` rows: neither the buckets nor their rows grow faster than the root."""
    return max(1, n // max(256, math.isqrt(n)))


def seeded_key(seed: int, *columns: str) -> Column:
    """A row's place in [0, 1) in the order of a seeded shuffle."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def with_ranks(df: DataFrame, group: list[str], key: str, ties: list[str], buckets: int, rank: str, size: str) -> DataFrame:
    """Adds ``rank`` (from 0, by ``key`` in [0, 1) and then ``ties``) and ``size`` in each group.

    ``df`` is read twice, so it should be cheap to read, as a written table is.
    """
    df = df.withColumn("_bucket", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*group)
    counts = counts.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(size),
    )
    place = W.partitionBy(*group, "_bucket").orderBy(key, *ties)
    return (
        df.join(counts, [*group, "_bucket"])
        .withColumn(rank, F.col("_before") + F.row_number().over(place) - 1)
        .drop("_bucket", "_before")
    )
