"""Filters, projections, paging.

Date filters compare the raw date column with a bound (never ``year(d) = y``)
so Catalyst can push them into the parquet scan and prune month partitions.
Relative periods anchor on the latest date in the data (:func:`latest_date`),
read first and used as a literal, so the scan is pruned.
"""

from __future__ import annotations

import calendar
import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.functions.scalar import status_from_flag

DATE = "claim_prov_date"


MONTH = "claim_month"  # partition column of the stored claims, ``yyyy-MM``


def _months(df: DataFrame, start: _dt.date | None, end: _dt.date | None) -> DataFrame:
    """Restrict the partition column, where there is one, to the months of a
    date range, so that the scan opens no other folder; drop it then."""
    if MONTH not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col(MONTH) >= f"{start:%Y-%m}")
    if end is not None:
        df = df.where(F.col(MONTH) <= f"{end:%Y-%m}")
    return df.drop(MONTH)


def latest_date(df: DataFrame, date_col: str = DATE) -> _dt.date | None:
    """The latest date of a table: one row read on the driver.  With a month
    column the latest month comes from the folder names and only that folder
    is read."""
    if MONTH in df.columns:
        # a line without a date lies in Hive's default folder, which is null here
        last = df.agg(F.max(MONTH)).first()[0]
        df = df.where(F.col(MONTH) == last) if last is not None else df
    return df.agg(F.max(date_col)).first()[0]


def relative_period(df: DataFrame, period: str = "12m", date_col: str = DATE) -> DataFrame:
    """``all``/``3m``/``6m``/``12m``/``24m`` back from the latest date."""
    if period not in D.RELATIVE_MONTHS:
        raise ValueError(f"unknown period {period!r}; one of {list(D.RELATIVE_MONTHS)}")
    months = D.RELATIVE_MONTHS[period]
    if months is None:
        return df.drop(MONTH)
    last = latest_date(df, date_col)
    if last is None:
        return df.drop(MONTH).limit(0)
    y, m = divmod(last.year * 12 + last.month - 1 - months, 12)
    start = _dt.date(y, m + 1, min(last.day, calendar.monthrange(y, m + 1)[1]))
    return _months(df, start, last).where(F.col(date_col) > F.lit(start))


def calendar_year(df: DataFrame, year: int, date_col: str = DATE) -> DataFrame:
    """one calendar year, as a range on the raw column."""
    return _months(df, _dt.date(year, 1, 1), _dt.date(year, 12, 31)).where(
        (F.col(date_col) >= F.lit(_dt.date(year, 1, 1))) & (F.col(date_col) < F.lit(_dt.date(year + 1, 1, 1))))


def recent_days(df: DataFrame, days: int = 30, date_col: str = DATE) -> DataFrame:
    """the last ``days`` days up to the latest date."""
    last = latest_date(df, date_col)
    if last is None:
        return df.drop(MONTH).limit(0)
    start = last - _dt.timedelta(days=days)
    return _months(df, start, last).where(F.col(date_col) > F.lit(start))


def date_range(df: DataFrame, start=None, end=None, date_col: str = DATE) -> DataFrame:
    """both ends kept, each optional; start after end is refused."""
    s = _dt.date.fromisoformat(start) if isinstance(start, str) else start
    e = _dt.date.fromisoformat(end) if isinstance(end, str) else end
    if s is not None and e is not None and s > e:
        raise ValueError("start date is after end date")
    df = _months(df, s, e)
    cond = F.lit(True)
    if s is not None:
        cond = cond & (F.col(date_col) >= F.lit(s))
    if e is not None:
        cond = cond & (F.col(date_col) <= F.lit(e))
    return df.where(cond)


def equals_or_all(df: DataFrame, **criteria) -> DataFrame:
    """``column=value`` filters where ``all``/None/'' means no filter."""
    for c, v in criteria.items():
        if v is None or v == "" or (isinstance(v, str) and v.lower() == "all"):
            continue
        df = df.where(F.col(c) == F.lit(v))
    return df


def amount_range(df: DataFrame, low=None, high=None, col: str = "amount") -> DataFrame:
    """amount between low and high, both kept, each optional."""
    if low is not None:
        df = df.where(F.col(col) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(col) <= F.lit(high))
    return df


def member_of(df: DataFrame, col: str, values) -> DataFrame:
    """membership.  A short Python list becomes ``isin`` (pushed to the
    scan); a DataFrame of values becomes a left-semi join, which scales with
    the list and never duplicates rows."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        vcol = values.columns[0]
        return df.join(values.select(F.col(vcol).alias("__v")).distinct(),
                       F.col(col) == F.col("__v"), "left_semi")
    values = list(values)
    if not values:
        return df
    return df.where(F.col(col).isin(values))


def custom_filter(df: DataFrame, start=None, end=None, amount_min=None, amount_max=None,
                  categories: Sequence[str] | None = None,
                  providers: Sequence[str] | None = None) -> DataFrame:
    """F8: AND of F4, F6, F7 -> the report columns."""
    out = date_range(df, start, end)
    out = amount_range(out, amount_min, amount_max)
    out = member_of(out, "benefit", categories)
    out = member_of(out, "prov_name", providers)
    return out.select(F.col("claim_ce").alias("claim_id"), F.col(DATE).alias("date"),
                      "claim_me", F.col("prov_name").alias("provider_name"),
                      F.col("benefit").alias("category"),
                      F.col("icd10_code").alias("diagnosis"), "amount")


def filter_count(df: DataFrame) -> DataFrame:
    """F8's ``filter_count`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("filter_count"))


def risk_level(score: str | Column = "fraud_score") -> Column:
    """Low < .4 <= Medium < .7 <= High; ``Unknown`` without a score."""
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(s.isNull(), "Unknown")
    for bound, name in D.RISK_BANDS:
        out = out.when(s < F.lit(bound), name)
    return out.otherwise("High")


def by_risk_level(df: DataFrame, level: str | None, score: str = "fraud_score") -> DataFrame:
    if level is None or level.lower() == "all":
        return df
    return df.where(risk_level(score) == level)


def score_at_least(df: DataFrame, threshold: float, score: str = "fraud_score") -> DataFrame:
    """``score >= t``; t in 0.1..1.0 by 0.05."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be within [0, 1]")
    return df.where(F.col(score) >= F.lit(threshold).cast("decimal(3,2)"))


def text_search(df: DataFrame, query: str, cols: Iterable[str] | None = None) -> DataFrame:
    """every whitespace-separated term must appear (case-insensitive)
    in the row's text."""
    text = search_text(cols if cols is not None else df.columns)
    for term in search_terms(query):
        df = df.where(text.contains(term))
    return df


def search_text(cols: Iterable[str]) -> Column:
    """The text of a row that F11 searches."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))


def search_terms(query: str) -> list[str]:
    return query.lower().split()


def claim_lookup(df: DataFrame, claim_id: str, key: str = "line_id") -> DataFrame:
    """one claim by id."""
    return df.where(F.col(key) == F.lit(claim_id))


def drilldown(df: DataFrame, flag: str = "fraud_flag") -> DataFrame:
    """claim rows with a review status."""
    return df.select(F.col("line_id").alias("claim_id"), F.col(DATE).alias("date"), "claim_me",
                     F.col("prov_name").alias("provider_name"),
                     F.col("icd10_code").alias("diagnosis"), "amount",
                     status_from_flag(F.col(flag)).alias("status"))


def newest_first(df: DataFrame, date_col: str = DATE, key: str = "line_id") -> DataFrame:
    """O1: default order, newest first (ties by key for a total order)."""
    return df.orderBy(F.desc(date_col), F.asc(key))


def page(df: DataFrame, order: Sequence[Column], size: int = 10, number: int = 1) -> DataFrame:
    """O3: page ``number`` (1-based) of ``size`` rows under a total order."""
    if size <= 0 or number <= 0:
        raise ValueError("page size and number must be positive")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    """First k rows (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def selected(df: DataFrame, ids: DataFrame, key: str = "line_id") -> DataFrame:
    """Rows whose key is in a table of selected ids (left-semi join)."""
    return member_of(df, key, ids)


def union_datasets(*dfs: DataFrame) -> DataFrame:
    """Several datasets as one; missing columns are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
