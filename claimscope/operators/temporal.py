"""Calendar roll-ups, trends and windows.

Windows that order a whole series (cumulative, rolling, lag) run after the
claims are grouped to periods, so they see one row per day/week/month: the
number of rows is bounded by the calendar, not by the data.  Windows over
unbounded keys (providers, members) use the partitioned helpers instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.plans.distributed import dense_rank_desc, null_safe_join, quantile_row

DATE = "claim_prov_date"
MONEY = "decimal(22,2)"

METRIC_COLUMNS = {"Total Amount": "total_amount", "Claim Count": "line_count",
                  "Average Amount": "avg_amount", "Max Amount": "max_amount",
                  "Min Amount": "min_amount"}


def period_of(unit: str, date_col: str = DATE) -> Column:
    if unit not in D.ROLLUP_UNITS:
        raise ValueError(f"unit must be one of {D.ROLLUP_UNITS}")
    return F.date_trunc(unit, F.col(date_col)).cast("date")


def month_index(month: str | Column) -> Column:
    """Months since 1970-01 (the regression's time axis)."""
    m = F.col(month) if isinstance(month, str) else month
    return ((F.year(m) - 1970) * 12 + F.month(m) - 1).cast("int")


def rollup(df: DataFrame, unit: str = "month", metric: str | None = None,
           date_col: str = DATE, by: Sequence[str] = ()) -> DataFrame:
    """Per period (day/week/month/quarter/year; weeks start Monday) the
    five metrics, or one of them when ``metric`` is given."""
    out = (df.groupBy(*by, period_of(unit, date_col).alias("period"))
           .agg(F.count(F.lit(1)).alias("line_count"),
                F.sum("amount").cast(MONEY).alias("total_amount"),
                (F.sum("amount").cast("double") / F.count("amount")).alias("avg_amount"),
                F.max("amount").alias("max_amount"), F.min("amount").alias("min_amount")))
    if metric is not None:
        out = out.select(*by, "period", F.col(METRIC_COLUMNS[metric]).alias("value"))
    return out


def cumulative(df: DataFrame, unit: str = "month") -> DataFrame:
    """Running total over periods (one row per period)."""
    per = rollup(df, unit).select("period", "total_amount")
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("cumulative_amount", F.sum("total_amount").over(w).cast(MONEY))


def day_of_week(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """Monday = 1 ... Sunday = 7."""
    return (df.groupBy((F.weekday(date_col) + 1).alias("dow"),
                       F.date_format(date_col, "EEEE").alias("day_name"))
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.sum("amount").cast(MONEY).alias("total_amount")))


def seasonality(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """Calendar month comparison across years."""
    return (df.groupBy(F.month(date_col).alias("month_of_year"))
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.sum("amount").cast(MONEY).alias("total_amount"),
                 (F.sum("amount").cast("double") / F.count("amount")).alias("avg_amount")))


def hour_of_day(df: DataFrame, ts_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Activity by hour of day (needs a timestamp; claims hold dates)."""
    return (df.groupBy(F.hour(ts_col).alias("hour"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.round(F.sum(value_col), 4).alias("total_value")))


def monthly_box(df: DataFrame, date_col: str = DATE, col: str = "amount") -> DataFrame:
    """Min, q1, median, q3, max of line amounts per month."""
    m = df.select(F.date_trunc("month", F.col(date_col)).cast("date").alias("month"), col)
    q = quantile_row(m, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["month"])
    ext = m.groupBy("month").agg(F.min(col).cast("double").alias("min"),
                                 F.max(col).cast("double").alias("max"))
    return null_safe_join(ext, q, ["month"], "left").select("month", "min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max")


def heatmap(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """Calendar month x day of week (long form)."""
    return (df.groupBy(F.month(date_col).alias("month_of_year"),
                       (F.weekday(date_col) + 1).alias("dow"))
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.sum("amount").cast(MONEY).alias("total_amount")))


def heatmap_wide(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """W7 wide: one row per calendar month, one line-count column per day
    of week (1 = Monday ... 7 = Sunday); the pivot values are given, so no
    distinct-values job runs first."""
    return (df.withColumn("dow", F.weekday(date_col) + 1)
            .groupBy(F.month(date_col).alias("month_of_year"))
            .pivot("dow", list(range(1, 8))).count().na.fill(0))


def rolling_average(df: DataFrame, unit: str = "month", periods: int = D.ROLLING_PERIODS) -> DataFrame:
    """Mean of the last ``periods`` period totals (shorter at the start)."""
    per = rollup(df, unit).select("period", "total_amount")
    w = Window.orderBy("period").rowsBetween(-(periods - 1), Window.currentRow)
    return per.withColumn("rolling_avg", F.sum("total_amount").over(w).cast("double")
                          / F.count(F.lit(1)).over(w))


def anomalies(df: DataFrame, unit: str = "month", z: float = D.ANOMALY_Z) -> DataFrame:
    """Period totals with |z| > 2 flagged (mean and sample sd over all
    periods, a one-row broadcast)."""
    per = rollup(df, unit).select("period", "total_amount")
    st = F.broadcast(per.agg(F.avg(F.col("total_amount").cast("double")).alias("__m"),
                             F.stddev_samp(F.col("total_amount").cast("double")).alias("__s")))
    zz = F.try_divide(F.col("total_amount").cast("double") - F.col("__m"), F.col("__s"))
    return (per.crossJoin(st)
            .select("period", "total_amount", F.round(zz, 4).alias("z_score"),
                    F.coalesce(F.abs(zz) > F.lit(z), F.lit(False)).alias("is_anomaly")))


def dense_months(df: DataFrame, by: Sequence[str] = (), date_col: str = DATE,
                 value: str = "amount") -> DataFrame:
    """Monthly totals per series with empty months filled with 0,
    from each series' first to its last month.  A null key is a series of its
    own; lines without a date belong to no month."""
    by = list(by)
    actual = (df.groupBy(*by, F.date_trunc("month", F.col(date_col)).cast("date").alias("month"))
              .agg(F.sum(value).cast(MONEY).alias("amount"),
                   F.count(F.lit(1)).alias("line_count")))
    bounds = actual.groupBy(*by).agg(F.min("month").alias("__a"), F.max("month").alias("__b"))
    cal = bounds.select(*by, F.explode(F.sequence("__a", "__b", F.expr("interval 1 month")))
                        .alias("month"))
    return (null_safe_join(cal, actual, by + ["month"], "left")
            .select(*by, "month", F.coalesce("amount", F.lit(0).cast(MONEY)).alias("amount"),
                    F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count")))


def decomposition(df: DataFrame) -> DataFrame:
    """Additive decomposition of the monthly total: trend = centred
    2x12 moving average (null where the window is incomplete), seasonal =
    mean detrended value of the calendar month, residual = rest.  The trend
    is the exact decimal sum of both 12-month windows over 24."""
    s = dense_months(df).select("month", F.col("amount").alias("y"))
    w1 = Window.orderBy("month").rowsBetween(-6, 5)
    w2 = Window.orderBy("month").rowsBetween(-5, 6)
    full = (F.count(F.lit(1)).over(w1) == 12) & (F.count(F.lit(1)).over(w2) == 12)
    t = s.withColumn("trend", F.when(full, (F.sum("y").over(w1) + F.sum("y").over(w2)).cast("double")
                                     / F.lit(24.0)))
    t = t.withColumn("detrended", F.col("y").cast("double") - F.col("trend"))
    seas = (t.where(F.col("trend").isNotNull()).groupBy(F.month("month").alias("__moy"))
            .agg(F.avg("detrended").alias("seasonal")))
    return (t.join(seas, F.month("month") == F.col("__moy"), "left")
            .select("month", F.col("y").alias("amount"), "trend",
                    F.round("seasonal", 2).alias("seasonal"),
                    F.round(F.col("y").cast("double") - F.col("trend") - F.col("seasonal"), 2).alias("residual")))


def weekly_pattern(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """Average daily total for each day of week, across the weeks
    that have claims on that day."""
    daily = (df.groupBy(F.col(date_col).alias("day"))
             .agg(F.sum("amount").alias("amount")))
    return (daily.groupBy((F.weekday("day") + 1).alias("dow"))
            .agg(F.count(F.lit(1)).alias("days"),
                 (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("mean_amount")))


def trend_line(df: DataFrame) -> DataFrame:
    """Monthly totals with a least-squares trend (months since 1970)."""
    s = dense_months(df).withColumn("t", month_index("month"))
    fit = F.broadcast(s.agg(F.regr_slope(F.col("amount").cast("double"), "t").alias("__b"),
                            F.regr_intercept(F.col("amount").cast("double"), "t").alias("__a")))
    return (s.crossJoin(fit)
            .select("month", "amount", F.round(F.col("__a") + F.col("__b") * F.col("t"), 2).alias("trend")))


def growth_rate(x: str | Column, order: Sequence[str], by: Sequence[str] = ()) -> Column:
    """100 * (x / previous x - 1); null for the first or a zero base."""
    c = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    prev = F.lag(c, 1).over(w)
    return F.lit(100.0) * (F.try_divide(c.cast("double"), F.nullif(prev.cast("double"), F.lit(0.0))) - F.lit(1.0))


def member_segments(df: DataFrame) -> DataFrame:
    """Member spending segments by the quartiles of member totals:
    Low <= p25 < Medium <= p50 < High <= p75 < Very High (ties share);
    members without any amount are ``Unknown``."""
    members = df.groupBy("claim_me").agg(F.sum("amount").cast(MONEY).alias("total_amount"))
    cuts = F.broadcast(quantile_row(members, "total_amount",
                                    {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}))
    v = F.col("total_amount").cast("double")
    seg = (F.when(v.isNull(), "Unknown").when(v <= F.col("__q1"), "Low").when(v <= F.col("__q2"), "Medium")
           .when(v <= F.col("__q3"), "High").otherwise("Very High"))
    return members.crossJoin(cuts).select("claim_me", "total_amount", seg.alias("segment"))


def segment_summary(df: DataFrame) -> DataFrame:
    return (member_segments(df).groupBy("segment")
            .agg(F.count(F.lit(1)).alias("members"),
                 F.sum("total_amount").cast(MONEY).alias("total_amount")))


def ranked(df: DataFrame, col: str = "prov_name") -> DataFrame:
    """Dense rank by total amount (descending) after grouping."""
    g = df.groupBy(col).agg(F.sum("amount").cast(MONEY).alias("total_amount"))
    return dense_rank_desc(g, "total_amount", out="rank")
