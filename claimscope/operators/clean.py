"""Cleaning and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.plans.stored import cut

DATE = "claim_prov_date"


def sparse_columns(df: DataFrame, limit: float = D.SPARSE_COLUMN_LIMIT) -> list[str]:
    """Columns with ``limit`` (80 %) or more missing, from one
    aggregation pass.  The answer decides the output schema, so this one
    row of ratios (one value per column) is read on the driver."""
    if not df.columns:
        return []
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] is not None and row[c] >= limit]


def clean(df: DataFrame, required: Sequence[str] = (DATE, "amount"),
          limit: float = D.SPARSE_COLUMN_LIMIT) -> DataFrame:
    """C5 + C6: drop sparse columns, then exact duplicate rows, then rows
    missing a required field (those still present)."""
    drop = sparse_columns(df, limit)
    out = distinct_rows(df.drop(*drop))
    keep = [c for c in required if c in out.columns]
    return out.na.drop(subset=keep) if keep else out


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df.dropDuplicates()`` for rows that are wide and seldom repeated: the
    64-bit hashes of the rows are counted, and only rows whose hash comes
    twice or more are compared, by all their columns.  The repeated hashes are
    written, so the planner knows their size: few are broadcast and the other
    rows stay in place; with many, the rows move by hash, once."""
    zeros = {c: F.col(c) + F.lit(0).cast(kind) for c, kind in df.dtypes if kind in ("float", "double")}  # -0.0 is 0.0, as in any grouping
    rows = df.withColumns(zeros).withColumn("__hash", F.xxhash64(*df.columns))
    again = cut(rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__hash"), "repeated-hashes")
    alone = rows.join(again, "__hash", "left_anti")
    return alone.unionByName(rows.join(again, "__hash", "left_semi").dropDuplicates()).drop("__hash")


def cleaning_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """original_rows, final_rows, rows_removed, original_cols,
    final_cols, cols_removed, columns_dropped."""
    dropped = [c for c in before.columns if c not in after.columns]
    a = before.agg(F.count(F.lit(1)).alias("original_rows"))
    b = after.agg(F.count(F.lit(1)).alias("final_rows"))
    return (a.crossJoin(b)
            .select("original_rows", "final_rows",
                    (F.col("original_rows") - F.col("final_rows")).alias("rows_removed"),
                    F.lit(len(before.columns)).alias("original_cols"),
                    F.lit(len(after.columns)).alias("final_cols"),
                    F.lit(len(dropped)).alias("cols_removed"),
                    F.lit(", ".join(dropped)).alias("columns_dropped")))


def preview(df: DataFrame, order: Sequence[str], n: int = D.PREVIEW_ROWS,
            cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in key order, every value as text, missing '-'."""
    cols = list(cols) if cols else df.columns
    return (df.orderBy(*order).limit(n)
            .select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in cols]))


def valid_range(df: DataFrame, date_col: str = DATE) -> DataFrame:
    """Cleaned record count and the valid date range."""
    return df.agg(F.count(F.lit(1)).alias("record_count"),
                  F.count(date_col).alias("dated_records"),
                  F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def invalid_amounts(raw: DataFrame, amount_col: str = "AMOUNT", id_col: str = "ADMIT_ID") -> DataFrame:
    """Rows whose normalised amount text is not a plain number, or is one
    that the amount type cannot hold (all of them; the import report shows the
    first 10)."""
    norm = F.trim(F.regexp_replace(F.col(amount_col).cast("string"), ",", ""))
    return (raw.select(F.col(id_col).alias(id_col), norm.alias(amount_col))
            .where(~F.coalesce(F.col(amount_col).rlike(D.AMOUNT_PATTERN), F.lit(False))
                   | F.col(amount_col).try_cast("double").try_cast("decimal(12,2)").isNull()))
