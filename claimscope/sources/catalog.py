"""Datasets by name, columns, filter options, exports, report bundles
(S5-S8, S10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import definitions as D


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A dataset by catalog name, or a parquet path."""
    if "/" in name or name.endswith(".parquet"):
        return spark.read.parquet(name)
    return spark.table(name)


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add each wanted result column from the first alias the dataset
    has (``claim_id`` <- ``claim_ce``, ``date`` <- ``claim_prov_date``,
    ``provider_name`` <- ``prov_name``); null when none exists."""
    aliases = D.DATASET_ALIASES if aliases is None else aliases
    out = df
    for want, options in aliases.items():
        present = [c for c in options if c in df.columns]
        if want in df.columns:
            continue
        out = out.withColumn(want, F.coalesce(*[F.col(c) for c in present]) if present else F.lit(None))
    return out


def list_columns(df: DataFrame) -> DataFrame:
    """``column, type`` of a dataset (schema metadata, no scan)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def list_datasets(spark: SparkSession) -> DataFrame:
    """Datasets in the current catalog database."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, table_type string")


def filter_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of a column, sorted."""
    return (df.select(F.col(col).alias("value")).where(F.col("value").isNotNull())
            .distinct().orderBy("value"))


def filter_ranges(df: DataFrame, date_col: str = "claim_prov_date", amount_col: str = "amount") -> DataFrame:
    """min/max of date and amount, one row."""
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"),
                  F.min(amount_col).alias("min_amount"), F.max(amount_col).alias("max_amount"))


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header, values quoted where needed, quotes doubled.  Output is one
    file per partition; ``single_file`` only for small results."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def report_bundle(scored: DataFrame, kind: str, threshold: float) -> dict[str, DataFrame]:
    """The results that make up a downloadable report."""
    from claimscope.operators import breakdown as A
    from claimscope.operators import forecast as M
    from claimscope.operators import fraud as R
    if kind == "forecast":
        return {"forecast": M.forecast_table(scored, ["benefit"], 6),
                "accuracy": M.accuracy(scored, ["benefit"])}
    if kind == "fraud":
        return {"summary": R.dashboard_summary(scored, threshold),
                "high_risk": R.high_risk_claims(scored, threshold),
                "providers": R.provider_fraud(scored, threshold),
                "diagnoses": R.fraud_by(scored, threshold, "icd10_code")}
    if kind == "provider":
        return {"efficiency": A.provider_efficiency(scored),
                "fraud": R.provider_fraud(scored, threshold)}
    if kind == "member":
        from claimscope.operators.temporal import member_segments
        return {"segments": member_segments(scored), "frequency": A.claim_frequency(scored)}
    raise ValueError("kind is one of forecast, fraud, provider, member")


def write_bundle(bundle: Mapping[str, DataFrame], base: str) -> list[str]:
    """S10 + S8: every result of a bundle as CSV under ``base``."""
    return [export_csv(df, f"{base.rstrip('/')}/{name}") for name, df in bundle.items()]
