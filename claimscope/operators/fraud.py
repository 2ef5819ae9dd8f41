"""Fraud rules, scores and roll-ups.

The rule score (R4) moves the lines once, dealt by month and member, counts a
member's lines there and lets them meet marks of the claims over the fence.
Members that hold a large share of all lines in a month (:func:`_heavy`) are
dealt by diagnosis, too; theirs are counted by group-bys, which pre-aggregate
map-side.  One-row cut points (IQR fence, the quantity percentile) are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from claimscope import definitions as D
from claimscope.operators.filters import date_range, equals_or_all, risk_level
from claimscope.operators.stats import age_years
from claimscope.plans.distributed import quantile_row
from claimscope.plans.packed import NOTHING, Field, Packing

MONEY = "decimal(22,2)"
SCORE = "decimal(3,2)"
DATE = "claim_prov_date"


# ---------------------------------------------------------------- R1 - R3
def iqr_bounds(df: DataFrame, col: str = "amount", k: float = D.IQR_K) -> DataFrame:
    """One row ``q1, q3, lower, upper`` (Tukey fences, exact quartiles)."""
    q = quantile_row(df, col, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - F.lit(k) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def claim_totals(df: DataFrame) -> DataFrame:
    """Claim-level amounts (lines summed per claim)."""
    return (df.groupBy("claim_ce")
            .agg(F.sum("amount").cast(MONEY).alias("claim_total"),
                 F.min("pol_name").alias("pol_name"), F.min("benefit_desc").alias("benefit_desc"),
                 F.count(F.lit(1)).alias("line_count")))


def flag_outliers(df: DataFrame, col: str, k: float = D.IQR_K) -> DataFrame:
    """Rows with ``is_outlier`` against the fences of ``col``."""
    b = F.broadcast(iqr_bounds(df, col, k).select("lower", "upper"))
    v = F.col(col).cast("double")
    return (df.crossJoin(b)
            .withColumn("is_outlier", (v < F.col("lower")) | (v > F.col("upper")))
            .drop("lower", "upper"))


def suspicious_claims(df: DataFrame, k: int | None = 10) -> DataFrame:
    """R2: claims whose total lies outside the IQR fences, largest first."""
    out = (flag_outliers(claim_totals(df), "claim_total").where("is_outlier")
           .select(F.col("claim_ce").alias("claim_id"), F.col("claim_total").alias("amount"),
                   "pol_name", "benefit_desc", "line_count"))
    return out.orderBy(F.desc("amount"), F.asc("claim_id")).limit(k) if k else out


def fraud_statistics(df: DataFrame) -> DataFrame:
    """total_claims, suspicious_claims, fraud_percentage (claim level)."""
    f = flag_outliers(claim_totals(df), "claim_total")
    return (f.agg(F.count(F.lit(1)).alias("total_claims"),
                  F.count_if("is_outlier").alias("suspicious_claims"))
            .withColumn("fraud_percentage",
                        F.lit(100.0) * F.try_divide(F.col("suspicious_claims"), F.col("total_claims"))))


# ---------------------------------------------------------------- R4
def _pieces(df: DataFrame) -> int:
    """Pieces of a month in which lines are scored: with 7 years of months
    several for each task, yet few files where they are stored by month."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)


BUCKETS = 1024  # hash buckets of (member, month); at most a quarter of them are heavy


def _bucket() -> Column:
    return F.pmod(F.xxhash64("claim_me", "__mon"), F.lit(BUCKETS))


def _heavy(base: DataFrame) -> DataFrame:
    """Column ``__heavy``: the buckets of (member, month) that hold more than
    four times their even share of the lines, as one of a hot member does."""
    n = base.groupBy(_bucket().alias("__heavy")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.broadcast(n.agg(F.sum("__n").alias("__all")))
    return n.crossJoin(total).where(F.col("__n") * BUCKETS > F.col("__all") * 4).select("__heavy")


def score_packing(df: DataFrame, texts: Sequence[str] = ()) -> Packing:
    """How lines travel packed through :func:`rule_score`, with its marks."""
    mark = Field(BooleanType(), 0, 1)
    return Packing.fit(df, texts) | Packing({"__line": mark, "__busy": mark, "__over": mark, "__heavy": Field(LongType(), 0, BUCKETS - 1)})


def rule_score(df: DataFrame, max_lines: int = D.RULE_MAX_LINES,
               qty_pct: float = D.RULE_QTY_PCT, amount_factor: float = D.RULE_AMOUNT_FACTOR,
               iqr_k: float = D.IQR_K, weights: dict[str, Decimal] | None = None,
               threshold: float | None = None, carry: Packing | None = None) -> DataFrame:
    """The claims with five rule flags and ``fraud_score`` in [0, 1],
    an exact ``decimal(3,2)`` sum of the weights of the rules that fire.

    1. claim total above the upper IQR fence of claim totals;
    2. member + diagnosis repeated within a calendar month;
    3. more than ``max_lines`` lines of a member in a month;
    4. quantity at or above the ``qty_pct`` percentile of quantities;
    5. amount above ``amount_factor`` x the diagnosis' mean amount.
    With ``threshold``, ``fraud_flag`` marks ``score >= threshold``.  Every
    line comes back; a rule whose input or key is null does not fire.  Only
    keys and amounts are grouped and joined; the lines themselves move once,
    by month and a hash of the member (of a heavy one, the diagnosis, too), to
    where they are counted and meet the marks of the claims over the fence; with
    ``carry`` their columns are packed on the way.
    """
    w = dict(D.RULE_WEIGHTS if weights is None else weights)
    base = df.withColumn("__mon", F.date_trunc("month", F.col(DATE)).cast("date"))
    # The fence and the claims over it read one exchange of the totals: a filter
    # or join key that drops the null claim would be pushed below one of them.
    totals = base.groupBy("claim_ce").agg(F.sum("amount").alias("__claim_total"))
    fence = F.broadcast(quantile_row(totals, "__claim_total", {"__q1": 0.25, "__q3": 0.75})
                        .select((F.col("__q3") + F.lit(iqr_k) * (F.col("__q3") - F.col("__q1"))).alias("__fence")))
    over = (totals.crossJoin(fence).where(F.col("__claim_total").cast("double") > F.col("__fence"))
            .select(F.col("claim_ce").alias("__ce")))
    q99 = F.broadcast(quantile_row(base, "quantity", {"__qp": qty_pct}))
    # A row for each code of the diagnosis list.  Left to AQE, partial sums of many
    # tasks look too large to broadcast and all lines move again, by diagnosis.
    diag = F.broadcast(base.where(F.col("icd10_code").isNotNull()).groupBy("icd10_code")
                       .agg((F.sum("amount").cast("double") / F.count("amount")).alias("__diag_mean")))
    keys = ["claim_me", "icd10_code", "__mon"]
    # A null key is no group: its own rule stays silent, the others count on.
    whole = F.col("claim_me").isNotNull() & F.col("__mon").isNotNull()
    heavy = F.broadcast(_heavy(base.where(whole)))
    # The lines of a heavy member in a month are added over its diagnoses' counts.
    member = (base.where(whole).join(heavy, _bucket() == F.col("__heavy"))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    member = member.withColumn("__mm_n", F.sum("__n").over(Window.partitionBy("claim_me", "__mon")))
    # Marks: one of each diagnosis of a heavy member that is busy, one of each
    # line of a claim over the fence.  They meet the lines in windows, where null
    # keys are equal.
    busy = member.where(F.col("__mm_n") > max_lines).select(*keys, F.lit(True).alias("__busy"))
    high = (base.where(F.col("claim_ce").isNotNull()).select("claim_ce", *keys)
            .join(over, F.col("claim_ce").eqNullSafe(F.col("__ce"))).select("claim_ce", *keys, F.lit(True).alias("__over")))
    j = (base.withColumn("__line", F.lit(True)).unionByName(busy, allowMissingColumns=True)
         .unionByName(high, allowMissingColumns=True))
    # Lines without a member or month have no key that fires: dealt by claim.
    j = j.join(heavy, F.when(whole, _bucket()) == F.col("__heavy"), "left")
    j = j.withColumn("__piece", F.pmod(F.xxhash64("claim_me", F.when(F.col("__heavy").isNotNull(), F.col("icd10_code")),
                                                  F.when(~whole, F.col("claim_ce"))), F.lit(_pieces(df))))
    key = ["__mon", "__piece", "claim_me"]
    lines = lambda *by: F.count("__line").over(Window.partitionBy(*key, *by))
    carry = carry or NOTHING
    dealt = carry.through(carry.numbers(j), ["__mon", "__piece"], lambda rows: rows.repartition("__mon", "__piece"))
    j = (carry.values(dealt).withColumn("__over", F.max("__over").over(Window.partitionBy(*key, "icd10_code", "claim_ce")))
         .withColumns({"__n": lines("icd10_code"), "__busy": F.max("__busy").over(Window.partitionBy(*key, "icd10_code"))})
         .withColumn("__mm_n", lines()).where("__line"))
    j = j.join(diag, "icd10_code", "left").crossJoin(q99)

    rules = {
        "claim_total_outlier": F.col("__over"),
        "member_diagnosis_repeat": whole & F.col("icd10_code").isNotNull() & (F.col("__n") > 1),
        "member_month_lines": whole & F.when(F.col("__heavy").isNull(), F.col("__mm_n") > max_lines).otherwise(F.col("__busy")),
        "quantity_p99": F.col("quantity").cast("double") >= F.col("__qp"),
        "amount_vs_diagnosis_mean": F.col("amount").cast("double") > F.lit(amount_factor) * F.col("__diag_mean"),
    }
    score = None
    for name, cond in rules.items():
        term = F.when(F.coalesce(cond, F.lit(False)), F.lit(w[name]).cast(SCORE)).otherwise(
            F.lit(0).cast(SCORE))
        score = term if score is None else score + term
    out = j
    for name, cond in rules.items():
        out = out.withColumn(f"rule_{name}", F.coalesce(cond, F.lit(False)))
    out = out.withColumn("fraud_score", score.cast(SCORE))
    if threshold is not None:
        out = out.withColumn("fraud_flag", F.col("fraud_score") >= F.lit(threshold).cast(SCORE))
    return out.select(*df.columns, *[f"rule_{name}" for name in rules], "fraud_score", *(["fraud_flag"] if threshold is not None else []))


# ---------------------------------------------------------------- R5 - R9
def _flag(threshold: float) -> Column:
    return F.col("fraud_score") >= F.lit(threshold).cast(SCORE)


def run_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """fraud_count, total_claims (lines), fraud_rate_pct, fraud_amount."""
    return (scored.agg(F.count_if(_flag(threshold)).alias("fraud_count"),
                       F.count(F.lit(1)).alias("total_claims"),
                       F.sum(F.when(_flag(threshold), F.col("amount"))).cast(MONEY).alias("fraud_amount"))
            .withColumn("fraud_rate_pct", F.lit(100.0) * F.try_divide(F.col("fraud_count"), F.col("total_claims"))))


def dashboard_summary(scored: DataFrame, threshold: float,
                      high_risk: float = D.HIGH_RISK_SCORE) -> DataFrame:
    """R5 + high_risk_claims, avg_fraud_score, fraud_amount_pct,
    total_amount."""
    s = scored.agg(
        F.count_if(_flag(threshold)).alias("fraud_count"),
        F.count(F.lit(1)).alias("total_claims"),
        F.sum(F.when(_flag(threshold), F.col("amount"))).cast(MONEY).alias("fraud_amount"),
        F.count_if(_flag(high_risk)).alias("high_risk_claims"),
        (F.sum("fraud_score").cast("double") / F.count("fraud_score")).alias("avg_fraud_score"),
        F.sum("amount").cast(MONEY).alias("total_amount"))
    return (s.withColumn("fraud_rate_pct", F.lit(100.0) * F.try_divide(F.col("fraud_count"), F.col("total_claims")))
            .withColumn("fraud_amount_pct", F.lit(100.0) * F.try_divide(
                F.col("fraud_amount").cast("double"), F.col("total_amount").cast("double"))))


def score_histogram(scored: DataFrame, bins: int = D.SCORE_BINS) -> DataFrame:
    """Five bars of width .2 (1.0 falls in the last); empty bars 0."""
    b = F.least(F.floor(F.col("fraud_score") * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = scored.sparkSession.createDataFrame(
        [(i, f"{i / bins:.1f}-{(i + 1) / bins:.1f}") for i in range(bins)], "bin int, label string")
    return (F.broadcast(all_bins).join(counts, "bin", "left")
            .select("bin", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def high_risk_claims(scored: DataFrame, threshold: float, with_details: bool = False) -> DataFrame:
    """Lines at or above the threshold; a listing orders them by
    :func:`high_risk_order`."""
    cols = [F.col("line_id").alias("claim_id"), F.col(DATE).alias("date"), "amount",
            F.col("prov_name").alias("provider"), "icd10_code", "fraud_score"]
    if with_details:
        cols += [F.col("service_code").alias("service_type"),
                 age_years("dob", DATE).alias("patient_age")]
    return scored.where(_flag(threshold)).select(*cols)


def high_risk_order() -> list[Column]:
    return [F.desc("fraud_score"), F.asc("claim_id")]


# ---------------------------------------------------------------- R10 - R14
def _rate_aggs(threshold: float) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_claims"),
            F.count_if(_flag(threshold)).alias("fraud_count"),
            F.sum("amount").cast(MONEY).alias("total_amount"),
            F.sum(F.when(_flag(threshold), F.col("amount"))).cast(MONEY).alias("fraud_amount")]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("fraud_rate_pct", F.lit(100.0) * F.try_divide(F.col("fraud_count"), F.col("total_claims")))


def provider_risk_class(rate_pct: str | Column = "fraud_rate_pct") -> Column:
    """> 20 % High, > 10 % Medium, else Low."""
    r = F.col(rate_pct) if isinstance(rate_pct, str) else rate_pct
    out = None
    for bound, name in D.PROVIDER_RISK:
        out = F.when(r > F.lit(bound), name) if out is None else out.when(r > F.lit(bound), name)
    return out.otherwise("Low")


def fraud_by(scored: DataFrame, threshold: float, col: str) -> DataFrame:
    """Lines, fraud lines, amounts and rate per value."""
    return _with_rate(scored.groupBy(col).agg(*_rate_aggs(threshold)))


def provider_fraud(scored: DataFrame, threshold: float, sort: str = "count") -> DataFrame:
    """R10 + R11: per provider, sortable by ``count``, ``rate``, ``amount``."""
    p = (fraud_by(scored, threshold, "prov_name")
         .withColumn("risk_class", provider_risk_class()))
    key = {"count": "fraud_count", "rate": "fraud_rate_pct", "amount": "total_amount"}[sort]
    return p.orderBy(F.desc(key), F.asc("prov_name"))


def provider_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """total_providers, high_risk_providers, avg_fraud_rate_pct
    (unweighted mean of provider rates), total_fraud_cases."""
    p = fraud_by(scored, threshold, "prov_name").withColumn("risk_class", provider_risk_class())
    return p.agg(F.count(F.lit(1)).alias("total_providers"),
                 F.count_if(F.col("risk_class") == "High").alias("high_risk_providers"),
                 F.round(F.avg("fraud_rate_pct"), 6).alias("avg_fraud_rate_pct"),
                 F.sum("fraud_count").cast("long").alias("total_fraud_cases"))


def provider_vs_average(scored: DataFrame, threshold: float) -> DataFrame:
    """Each provider's rate next to the flat mean of all rates."""
    p = fraud_by(scored, threshold, "prov_name").select("prov_name", "fraud_rate_pct")
    avg = F.broadcast(p.agg(F.avg("fraud_rate_pct").alias("avg_rate_pct")))
    return p.crossJoin(avg).select("prov_name", "fraud_rate_pct",
                                   F.round("avg_rate_pct", 6).alias("avg_rate_pct"))


def fraud_by_hour(events: DataFrame, ts_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Events per hour and those outside the IQR fences of ``value``."""
    f = flag_outliers(events, value_col)
    return (f.groupBy(F.hour(ts_col).alias("hour"))
            .agg(F.count(F.lit(1)).alias("event_count"), F.count_if("is_outlier").alias("flagged"))
            .withColumn("flag_rate_pct", F.lit(100.0) * F.col("flagged") / F.col("event_count")))


def provider_mean_risk(scored: DataFrame) -> DataFrame:
    """Mean score (0-1) per provider with amount and line count."""
    return scored.groupBy(F.col("prov_name").alias("provider")).agg(
        (F.sum("fraud_score").cast("double") / F.count("fraud_score")).alias("fraud_risk_avg"),
        F.sum("amount").cast(MONEY).alias("total_amount"),
        F.count(F.lit(1)).alias("claim_count"))


def risk_by(scored: DataFrame, dim: str) -> DataFrame:
    """Mean score per value of a dimension (``month`` = calendar month
    of service)."""
    key = (F.date_trunc("month", F.col(DATE)).cast("date") if dim == "month" else F.col(dim))
    return scored.groupBy(key.alias(dim)).agg(
        (F.sum("fraud_score").cast("double") / F.count("fraud_score")).alias("avg_score"),
        F.count(F.lit(1)).alias("line_count"))


def amount_by_risk_level(scored: DataFrame) -> DataFrame:
    """Amount and lines by risk level (Low / Medium / High)."""
    return scored.groupBy(risk_level("fraud_score").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("amount").cast(MONEY).alias("total_amount"))


# ---------------------------------------------------------------- R15, R21, R22
def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision per line (ties by decision id), as a
    grouped ``max_by`` -- partial aggregation, no window over a hot key."""
    return decisions.groupBy("line_id").agg(
        F.max_by("status", F.struct("decided_at", "decision_id")).alias("status"))


def with_review_status(scored: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """``status`` = latest decision, ``Pending`` when there is none."""
    if decisions is None:
        return scored.withColumn("status", F.lit("Pending"))
    latest = latest_decisions(decisions)
    return (scored.join(latest, "line_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("Pending"))))


def potential_cases(scored: DataFrame, decisions: DataFrame | None = None, start=None,
                    end=None, level: str | None = None, provider: str | None = None) -> DataFrame:
    """Filtered scored lines with review status (the caller orders)."""
    s = date_range(scored, start, end)
    if level and level.lower() != "all":
        s = s.where(risk_level("fraud_score") == level)
    s = equals_or_all(s, prov_name=provider)
    s = with_review_status(s, decisions)
    return s.select(F.col("line_id").alias("claim_id"), F.col(DATE).alias("date"), "claim_me",
                    F.col("prov_name").alias("provider_name"), "amount", "fraud_score", "status")


def monthly_fraud_trend(scored: DataFrame, threshold: float) -> DataFrame:
    """Per month the flagged cases and amount."""
    return (scored.groupBy(F.date_trunc("month", F.col(DATE)).cast("date").alias("month"))
            .agg(F.count_if(_flag(threshold)).alias("cases"),
                 F.sum(F.when(_flag(threshold), F.col("amount"))).cast(MONEY).alias("fraud_amount"),
                 F.count(F.lit(1)).alias("line_count")))


def trend_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """total_claims, total_fraud, fraud_rate_pct, analysis_period."""
    return (scored.agg(F.count(F.lit(1)).alias("total_claims"),
                       F.count_if(_flag(threshold)).alias("total_fraud"),
                       F.min(DATE).alias("__a"), F.max(DATE).alias("__b"))
            .select("total_claims", "total_fraud",
                    (F.lit(100.0) * F.try_divide(F.col("total_fraud"), F.col("total_claims"))).alias("fraud_rate_pct"),
                    F.concat(F.date_format("__a", "yyyy-MM"), F.lit(" to "),
                             F.date_format("__b", "yyyy-MM")).alias("analysis_period")))
