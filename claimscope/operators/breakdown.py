"""Summary and breakdown aggregates.

Naming: ``claim_count`` counts distinct claims (``claim_ce``),
``line_count`` counts service lines; ``avg_per_member`` divides by unique
members, ``avg_amount`` by lines.  Money sums are exact ``decimal(22,2)``;
averages are the exact sum as double divided by the count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.scalar import mask_member
from claimscope.operators.stats import age_band, age_years
from claimscope.plans.distributed import running_total
from claimscope.plans.stored import cut

MONEY = "decimal(22,2)"


def total_amount(col: str = "amount") -> Column:
    return F.sum(col).cast(MONEY).alias("total_amount")


def line_count() -> Column:
    return F.count(F.lit(1)).alias("line_count")


def avg_amount(col: str = "amount") -> Column:
    return (F.sum(col).cast("double") / F.count(F.col(col))).alias("avg_amount")


def _per(num: str, den: str) -> Column:
    return F.try_divide(F.col(num).cast("double"), F.col(den))


def summary(df: DataFrame) -> DataFrame:
    """A1: total_claims (distinct claims), total_amount, unique_members,
    avg_per_member."""
    return (df.agg(F.count_distinct("claim_ce").alias("total_claims"), total_amount(),
                   F.count_distinct("claim_me").alias("unique_members"))
            .withColumn("avg_per_member", _per("total_amount", "unique_members")))


def summary_with_providers(df: DataFrame) -> DataFrame:
    """A2: A1 + unique_providers, claims_per_member."""
    return (df.agg(F.count_distinct("claim_ce").alias("total_claims"), total_amount(),
                   F.count_distinct("claim_me").alias("unique_members"),
                   F.count_distinct("prov_name").alias("unique_providers"))
            .withColumn("avg_per_member", _per("total_amount", "unique_members"))
            .withColumn("claims_per_member", _per("total_claims", "unique_members")))


def home_summary(df: DataFrame) -> DataFrame:
    """A3: total_invoices (distinct claim invoices), total_claims,
    total_amount, avg_per_member, unique_members."""
    return (df.agg(F.count_distinct("claim_in_global").alias("total_invoices"),
                   F.count_distinct("claim_ce").alias("total_claims"), total_amount(),
                   F.count_distinct("claim_me").alias("unique_members"))
            .withColumn("avg_per_member", _per("total_amount", "unique_members")))


def period_summary(df: DataFrame) -> DataFrame:
    """A4: line_count, total_amount, avg_amount (per line), max_amount."""
    return df.agg(line_count(), total_amount(), avg_amount(),
                  F.max("amount").alias("max_amount"))


def overview(df: DataFrame) -> DataFrame:
    """A5: line_count, total_amount, avg_amount."""
    return df.agg(line_count(), total_amount(), avg_amount())


def by_benefit(df: DataFrame) -> DataFrame:
    """benefit_type, line_count, total_amount."""
    return (df.groupBy(F.col("benefit").alias("benefit_type"))
            .agg(line_count(), total_amount()))


def top_claimants(df: DataFrame, k: int = 10) -> DataFrame:
    """Top policy holders by amount (ties by name)."""
    return (df.groupBy(F.col("pol_name").alias("policy_holder"))
            .agg(line_count(), total_amount())
            .orderBy(F.desc("total_amount"), F.asc("policy_holder")).limit(k))


def top_members_masked(df: DataFrame, k: int = 10) -> DataFrame:
    """Top members by amount, id masked after grouping."""
    top = (df.groupBy("claim_me").agg(total_amount(), line_count())
           .orderBy(F.desc("total_amount"), F.asc("claim_me")).limit(k))
    return top.select(mask_member("claim_me").alias("member"), "total_amount", "line_count")


def top_providers(df: DataFrame, k: int = 10) -> DataFrame:
    """Top providers by amount."""
    return (df.groupBy("prov_name").agg(total_amount(), line_count())
            .orderBy(F.desc("total_amount"), F.asc("prov_name")).limit(k))


def amount_by(df: DataFrame, col: str = "benefit") -> DataFrame:
    """Amount and lines per value of one column."""
    return df.groupBy(col).agg(line_count(), total_amount())


def two_level(df: DataFrame, outer: str = "benefit", inner: str = "benefit_desc") -> DataFrame:
    """Category -> subcategory with subtotals and the grand total
    (``level`` 0 = leaf, 1 = category subtotal, 3 = grand total)."""
    return (df.rollup(outer, inner)
            .agg(F.grouping_id().cast("int").alias("level"), line_count(), total_amount()))


def claim_frequency(df: DataFrame) -> DataFrame:
    """How many members have 1, 2, ... distinct claims."""
    per_member = df.groupBy("claim_me").agg(F.count_distinct("claim_ce").alias("n_claims"))
    return per_member.groupBy("n_claims").agg(F.count(F.lit(1)).alias("members"))


def lorenz(df: DataFrame, by: str = "prov_name") -> DataFrame:
    """Lorenz curve of cost over providers (ascending cost, ties by
    name): cumulative share of providers and of amount.  Distributed running
    totals, so any number of providers works."""
    totals = df.groupBy(by).agg(F.sum("amount").alias("total_amount"))
    cum = running_total(totals, ["total_amount", by], ["total_amount"])
    grand = F.broadcast(totals.agg(F.count(F.lit(1)).alias("__n"),
                                   F.sum("total_amount").alias("__t")))
    return (cum.crossJoin(grand)
            .select(by, F.col("total_amount").cast(MONEY).alias("total_amount"),
                    F.col("row_pos").alias("position"),
                    (F.col("row_pos") / F.col("__n")).alias("provider_share"),
                    (F.col("total_amount_cum").cast("double") / F.col("__t").cast("double"))
                    .alias("amount_share")))


def gini(df: DataFrame, by: str = "prov_name") -> DataFrame:
    """Gini of the Lorenz curve, 1 - sum((x_k - x_{k-1})(y_k + y_{k-1}))
    with equal provider steps: 1 - (2*sum(y_k) - 1) / n."""
    cur = lorenz(df, by)
    return cur.agg(F.round(F.lit(1.0) - (F.lit(2.0) * F.sum("amount_share") - F.lit(1.0))
                           / F.count(F.lit(1)), 6).alias("gini"),
                   F.count(F.lit(1)).alias("providers"))


METRICS = ("Count", "Sum of Amount", "Average Amount")


def breakdown(df: DataFrame, category: str, metric: str = "Count",
              filter_col: str | None = None, filter_values: Sequence[str] | None = None) -> DataFrame:
    """Any category by Count / Sum of Amount / Average Amount,
    optionally restricted to ``filter_col in filter_values``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if filter_col and filter_values:
        df = df.where(F.col(filter_col).isin(list(filter_values)))
    agg = {"Count": line_count().alias("value_count"),
           "Sum of Amount": total_amount().alias("value_sum"),
           "Average Amount": avg_amount().alias("value_avg")}[metric]
    return df.groupBy(F.col(category).alias("category")).agg(agg)


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Top k values of a column by line count (ties by value)."""
    return (df.groupBy(col).agg(line_count(), total_amount())
            .orderBy(F.desc("line_count"), F.asc(col)).limit(k))


def provider_analysis(df: DataFrame) -> DataFrame:
    """Per provider count, sum, average."""
    return df.groupBy("prov_name").agg(line_count(), total_amount(), avg_amount())


def diagnosis_treatment(df: DataFrame, wide: bool = False,
                        services: Sequence[str] | None = None) -> DataFrame:
    """Diagnosis x service line counts; long form, or wide with one
    column for every service code in the data.  ``services`` restricts the
    wide form on purpose; every other code then counts under ``other``."""
    if not wide:
        return df.groupBy("icd10_code", "service_code").agg(line_count())
    if services is None:
        return df.groupBy("icd10_code").pivot("service_code").count().na.fill(0)
    code = F.when(F.col("service_code").isin(list(services)), F.col("service_code")).otherwise("other")
    return (df.withColumn("service_code", code).groupBy("icd10_code")
            .pivot("service_code", [*services, "other"]).count().na.fill(0))


def age_service(df: DataFrame) -> DataFrame:
    """Age band x service."""
    return (df.withColumn("age_band", age_band(age_years("dob", "claim_prov_date")))
            .groupBy("age_band", "service_code").agg(line_count(), total_amount()))


def by_gender(df: DataFrame) -> DataFrame:
    """Lines, amount and members by gender."""
    return df.groupBy("gender").agg(line_count(), total_amount(),
                                    F.count_distinct("claim_me").alias("unique_members"))


def treatment_distribution(df: DataFrame, col: str = "service_code") -> DataFrame:
    """Lines per value with its share of all lines (grouped first; the
    total is a one-row broadcast)."""
    g = df.groupBy(col).agg(line_count())
    tot = F.broadcast(g.agg(F.sum("line_count").alias("__all")))
    return (g.crossJoin(tot)
            .withColumn("share", F.col("line_count") / F.col("__all")).drop("__all"))


def provider_efficiency(df: DataFrame) -> DataFrame:
    """Provider totals with score = overall average / provider average
    (> 1: cheaper than average)."""
    # Written once (a row for each provider), because Catalyst would plan the
    # grouping twice: the overall average comes from it, the lines are read once.
    per = cut(df.groupBy("prov_name").agg(line_count().alias("total_claims"), total_amount(),
                                          avg_amount(), F.count("amount").alias("__n")), "a23-providers")
    overall = F.broadcast(per.agg((F.sum("total_amount").cast("double") / F.sum("__n")).alias("__overall")))
    return (per.crossJoin(overall)
            .withColumn("efficiency_score", F.try_divide(F.col("__overall"), F.col("avg_amount")))
            .drop("__overall", "__n"))


def efficiency_extremes(df: DataFrame, k: int = 10, most: bool = True) -> DataFrame:
    """Most (or least) efficient providers."""
    eff = provider_efficiency(df)
    order = F.desc("efficiency_score") if most else F.asc("efficiency_score")
    return eff.orderBy(order, F.asc("prov_name")).limit(k)


def break_even(df: DataFrame, fixed_cost: float, variable_rate: float) -> DataFrame:
    """Claims needed to break even per provider,
    fixed / (avg x (1 - rate)); null at a 100 % rate."""
    if fixed_cost < 0 or not 0 <= variable_rate <= 100:
        raise ValueError("fixed_cost >= 0 and 0 <= variable_rate <= 100")
    margin = F.col("avg_amount") * (F.lit(1.0) - F.lit(variable_rate / 100.0))
    return (df.groupBy("prov_name").agg(avg_amount())
            .withColumn("break_even_claims",
                        F.try_divide(F.lit(float(fixed_cost)), F.nullif(margin, F.lit(0.0)))))
