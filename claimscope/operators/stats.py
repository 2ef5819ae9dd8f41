"""Profiling and descriptive statistics.

Quantiles are exact (linear interpolation) but computed by the partitioned
order-statistics helper, never by gathering a column into one buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from claimscope import definitions as D
from claimscope.functions.scalar import col_of
from claimscope.plans.distributed import exact_quantiles, quantile_row


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "value")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 %, max per numeric
    column, one row per column."""
    cols = list(cols) if cols else numeric_columns(df)
    long = _long_numeric(df, cols)
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantile_row(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by=["column"])
    q = q.select("column", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])
    return base.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count and row count, from one pass."""
    cols = list(cols) if cols else df.columns
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return (one.unpivot(["__rows"], cols, "column", "null_count")
            .select("column", F.col("null_count").cast("long").alias("null_count"),
                    F.col("__rows").alias("row_count")))


def distinct_profile(df: DataFrame, cols: Sequence[str] | None = None,
                     exact: bool = False) -> DataFrame:
    """Distinct values per column.  Exact counts go through one unpivot
    and one shuffle of (column, value) pairs; approximate ones are a single
    HyperLogLog pass."""
    cols = list(cols) if cols else df.columns
    if not exact:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return one.unpivot([], cols, "column", "distinct_count")
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
    return long.groupBy("column").agg(F.count_distinct("value").alias("distinct_count"))


def total_nulls(profile: DataFrame) -> DataFrame:
    """A25 over a profile: the sum of ``null_count`` over the columns."""
    return profile.agg(F.coalesce(F.sum("null_count"), F.lit(0)).cast("long").alias("total_nulls"))


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, long form, missing -> 0, in one
    aggregation pass."""
    cols = list(cols) if cols else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    dbl = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    aggs = [F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    if not aggs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    one = dbl.agg(*aggs)
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    parts = F.split("pair", r"\|")
    upper = long.select(parts[0].alias("col_a"), parts[1].alias("col_b"), "corr")
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
    return (upper.unionByName(lower).unionByName(diag)
            .select("col_a", "col_b", F.round(F.coalesce("corr", F.lit(0.0)), 6).alias("corr")))


def histogram(df: DataFrame, col: str = "amount", bins: int = 10) -> DataFrame:
    """Equal-width bins between min and max (the max lands in the
    last bin); every bin is returned, empty ones with 0."""
    v = F.col(col).cast("double")
    rng = F.broadcast(df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi")))
    width = F.col("__hi") - F.col("__lo")
    binned = (df.select(v.alias("__v")).where(F.col("__v").isNotNull()).crossJoin(rng)
              .select(F.when(width == 0, F.lit(1)).otherwise(
                  F.least(F.floor((F.col("__v") - F.col("__lo")) / width * F.lit(float(bins))),
                          F.lit(bins - 1)) + 1).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = (rng.select("__lo", "__hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")))
    return (all_bins.join(binned, "bin", "left")
            .select("bin",
                    F.round(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("bin") - 1) / F.lit(float(bins)), 4).alias("bin_low"),
                    F.round(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("bin") / F.lit(float(bins)), 4).alias("bin_high"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """P5: lines per category value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("line_count"))


def cost_percentiles(df: DataFrame, col: str = "amount",
                     probs: Sequence[float] = tuple(D.COST_PERCENTILES)) -> DataFrame:
    """Cost at p10 ... p90, p95, p99 (exact, interpolated)."""
    q = exact_quantiles(df, col, list(probs), prob_col="percentile", out_col="value")
    return q.select((F.round(F.col("percentile") * 100)).cast("int").alias("percentile"),
                    F.round("value", 4).alias("value"))


def age_years(dob, on) -> Column:
    """Whole years from birth to the service date (birthday reached on
    the same month and day; 29 February birthdays count from 1 March)."""
    b, d = col_of(dob), col_of(on)
    before = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return (F.year(d) - F.year(b) - F.when(before, 1).otherwise(0)).cast("int")


def age_band(age) -> Column:
    """0-17, 18-34, 35-49, 50-64, 65+; ``Unknown`` without an age."""
    a = col_of(age)
    out = F.when(a.isNull(), "Unknown")
    for lo, hi, name in D.AGE_BANDS:
        if hi is None:
            return out.otherwise(name)
        out = out.when(a <= hi, name)
    return out


def age_profile(df: DataFrame) -> DataFrame:
    """Lines, members and amount by age band."""
    return (df.withColumn("age_band", age_band(age_years("dob", "claim_prov_date")))
            .groupBy("age_band")
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.count_distinct("claim_me").alias("unique_members"),
                 F.sum("amount").cast("decimal(22,2)").alias("total_amount")))
