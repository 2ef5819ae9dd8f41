"""Quantile sketches that merge (P1, P7 at scale).

A sketch is the histogram of a column over buckets of constant relative width
(:func:`claimscope.plans.distributed.order_bucket`, 0.024 % wide), kept as a
narrow table: key columns, bucket, count, least and greatest value of the
bucket.  Adding rows or merging keys (months into a year) is a sum over
buckets, so sketches are built once a month and any period is answered from
them without the lines.  The rank of a bucket is exact; a quantile lies
between the least and greatest value of its bucket, so its relative error is
at most ``ERROR`` and is 0 where a bucket holds one value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.plans.distributed import BUCKETS_PER_E, null_safe_join, order_bucket

ERROR = math.expm1(1 / BUCKETS_PER_E)


def build(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys + [bucket, n, low, high]``; nulls and NaN are left out.  A group
    has as many rows as buckets it meets, a few thousand in practice."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.groupBy(*keys, order_bucket(F.col("v")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def merge(sketch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketch of the groups ``keys``, from finer ones."""
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketch: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys + [p, low, high, q]``: the bucket that holds the value of rank
    floor(p (n - 1)), and the middle of it as the estimate."""
    merged = merge(sketch, keys)
    group = Window.partitionBy(*[F.col(k) for k in keys])
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("__end", F.sum("n").over(upto))
    total = merged.groupBy(*keys).agg(F.sum("n").alias("__all"))
    wanted = total.select(*keys, F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(float(p)) * (F.col("__all") - 1)).alias("rank")) for p in probs])).alias("w"))
    hit = null_safe_join(wanted, ranked, keys) if keys else wanted.crossJoin(ranked)  # a few ranks a group
    return (hit.where((F.col("w.rank") < F.col("__end")) & (F.col("w.rank") >= F.col("__end") - F.col("n")))
            .select(*keys, "w.p", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("q")))
