"""Named queries: one per operator of the inventory, each ``(spark, sf_dir)
-> DataFrame`` over the whole claims table derived from the given tables.

Parameters that the test data need (FIXTURES.md section 2) are fixed here
and repeated in :mod:`claimscope.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.functions import scalar as X
from claimscope.operators import breakdown as A
from claimscope.operators import filters as Fl
from claimscope.operators import forecast as M
from claimscope.operators import fraud as R
from claimscope.operators import stats as P
from claimscope.operators import temporal as W
from claimscope.plans.oracle import WITH_NULLS
from claimscope.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

THRESHOLD = D.TEST_THRESHOLD
FORECAST_KEYS = ["benefit"]
SERIES_KEYS = ["benefit", "prov_region"]


def q(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


_NULLS: ContextVar[bool] = ContextVar("nulls", default=False)


def claims(spark: SparkSession, sf: str, month: bool = False) -> DataFrame:
    """The stored claims; inside a ``*_with_nulls`` query with null keys,
    dates, births and amounts.  ``month`` adds the partition column for the
    date filters."""
    c = T.claims_table(spark, sf, month)
    return nulled(c) if _NULLS.get() else c


def nulled(c: DataFrame) -> DataFrame:
    """Claims as imported files have them: missing values in key columns."""
    n = F.col("quantity")
    amount = (n != 13) & (F.right("prov_name", F.lit(1)) != "3") & (F.right("claim_me", F.lit(2)) != "07")
    return c.withColumns({"icd10_code": F.when(n % 7 != 0, F.col("icd10_code")), "benefit": F.when(n % 5 != 0, F.col("benefit")),
                          "dob": F.when(n % 4 != 1, F.col("dob")), "claim_prov_date": F.when(n != 31, F.col("claim_prov_date")),
                          "amount": F.when(amount, F.col("amount"))})


def scored_lines(spark: SparkSession, sf: str, columns: Collection[str] = T.LINE_COLUMNS) -> DataFrame:
    """One scoring run (R4) over the stored lines: their columns, the rule
    columns and ``claim_month``.  The texts of a claim that follow from its
    keys are made after the lines have moved.  A run of some ``columns``, which
    is to be stored, moves them packed."""
    lines, carry = T.stored_lines(spark, sf).drop("claim_month"), None
    if _NULLS.get():
        own = {f"line_{c}": F.col(c) for c in T.LINE_COLUMNS}
        keys = nulled(T.claim_columns(lines.withColumns(own), *own))
        given = keys.select("claim_ce", "claim_me", "icd10_code", "claim_prov_date", "amount", "quantity", *own)
    elif columns is not T.LINE_COLUMNS:
        given = T.rule_keys(lines.select(*columns)).drop("order_key")  # the claim's number
        carry = R.score_packing(given, ["icd10_code", "benefit", "service_code", "prov_location", "prov_region"])
    else:
        given = T.rule_keys(lines)
    out = R.rule_score(given, max_lines=D.TEST_RULE_MAX_LINES, amount_factor=D.TEST_RULE_AMOUNT_FACTOR, threshold=THRESHOLD, carry=carry)
    if carry:
        out = out.withColumn("order_key", F.col("claim_ce"))
    own = [F.col(f"line_{c}").alias(c) for c in columns] if _NULLS.get() else columns
    return out.select(*own, *_flags(out), F.date_format("claim_prov_date", "yyyy-MM").alias("claim_month"))


def _flags(s: DataFrame) -> list[str]:
    return [c for c in s.columns if c.startswith(("rule_", "fraud_"))]


def _scored_claims(lines: DataFrame, *more: str, without: Collection[str] = ()) -> DataFrame:
    c = T.claim_columns(lines, *_flags(lines), *more, without=without)
    return nulled(c) if _NULLS.get() else c


def score_fresh(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_claims(scored_lines(spark, sf))


def scored(spark: SparkSession, sf: str, month: bool = False) -> DataFrame:
    """One scoring run (R4) per parameter set and source, stored by service
    month; the fraud pages aggregate the stored run (score once, read many).  It
    holds the columns that those pages read, so only they are dealt and written;
    the others are in the stored claims.  ``month`` adds the partition column for
    the date filters."""
    from claimscope.plans.stored import data_key, stored
    from claimscope.sources.csv_import import write_by_month
    key = (f"scored|{data_key(sf)}|{D.TEST_RULE_MAX_LINES}|{D.TEST_RULE_AMOUNT_FACTOR}"
           f"|{THRESHOLD}|{_NULLS.get()}")

    def build() -> DataFrame:
        return scored_lines(spark, sf, T.SCORED_LINE_COLUMNS)

    out = stored(spark, key, build, write_by_month, T.claim_sources(sf))
    return _scored_claims(out, *(["claim_month"] if month else []), without=T.UNSCORED_CLAIM_COLUMNS)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of review decisions, made for the test data (FIXTURES.md):
    every flagged line is 'Flagged' on its service date; lines with quantity
    >= 45 are also 'Approved' a week later."""
    from claimscope.plans.stored import data_key, stored

    def build() -> DataFrame:
        flagged = Fl.score_at_least(scored(spark, sf), THRESHOLD).select("line_id", "quantity", "claim_prov_date")
        row = lambda n, status, day: F.struct(F.lit(n).cast("long").alias("decision_id"), F.lit(status).alias("status"), day.cast("timestamp").alias("decided_at"))
        both = F.array(row(1, "Flagged", F.col("claim_prov_date")), row(2, "Approved", F.date_add("claim_prov_date", 7)))
        return flagged.select("line_id", F.explode(F.when(F.col("quantity") >= 45, both).otherwise(F.slice(both, 1, 1))).alias("d")).select("line_id", "d.*")

    key = f"decisions|{data_key(sf)}|{THRESHOLD}|{_NULLS.get()}"
    return stored(spark, key, build, sources=T.claim_sources(sf))


# ------------------------------------------------------------------ slice
@q("flagship_monthly_by_benefit_12m")
def _flagship(spark, sf):
    c = Fl.relative_period(claims(spark, sf, month=True), "12m")
    return (c.groupBy(F.col("benefit"), F.date_trunc("month", "claim_prov_date").cast("date").alias("month"))
            .agg(F.count(F.lit(1)).alias("line_count"),
                 F.count_distinct("claim_ce").alias("claim_count"),
                 F.sum("amount").cast("decimal(22,2)").alias("total_amount")))


# ------------------------------------------------------------------ sources
@q("s04_claims_scan")
def _s04(spark, sf):
    """S4 over the star join itself (the import's source side)."""
    return T.claims_view(spark, sf)


@q("s04_stored_claims_scan")
def _s04b(spark, sf):
    """S4 over the stored claims table."""
    return claims(spark, sf)


@q("s05_dataset_aliases")
def _s05(spark, sf):
    from claimscope.sources.catalog import resolve_aliases
    return resolve_aliases(claims(spark, sf)).select("claim_id", "date", "provider_name", "amount")


@q("s07_filter_values")
def _s07a(spark, sf):
    from claimscope.sources.catalog import filter_values
    return filter_values(claims(spark, sf), "benefit")


@q("s07_filter_ranges")
def _s07b(spark, sf):
    from claimscope.sources.catalog import filter_ranges
    return filter_ranges(claims(spark, sf))


# ------------------------------------------------------------------ cleaning
@q("c07_cleaning_stats")
def _c07(spark, sf):
    from claimscope.operators.clean import clean, cleaning_stats
    c = claims(spark, sf)
    return cleaning_stats(c, clean(c))


@q("c08_preview")
def _c08(spark, sf):
    from claimscope.operators.clean import preview
    return preview(claims(spark, sf), order=["line_id"])


@q("c09_valid_range")
def _c09(spark, sf):
    from claimscope.operators.clean import valid_range
    return valid_range(claims(spark, sf))


# ------------------------------------------------------------------ profiling
def _with_age(c: DataFrame) -> DataFrame:
    return c.withColumn("age", P.age_years("dob", "claim_prov_date"))


@q("p01_describe")
def _p01(spark, sf):
    return P.describe(_with_age(claims(spark, sf)), ["quantity", "amount", "age"])


@q("p02_null_profile")
def _p02(spark, sf):
    return P.null_profile(claims(spark, sf))


@q("p02_total_nulls")
def _p02b(spark, sf):
    return P.total_nulls(P.null_profile(claims(spark, sf)))


@q("p02_distinct_profile")
def _p02c(spark, sf):
    return P.distinct_profile(claims(spark, sf), ["icd10_code", "benefit", "prov_name", "claim_me",
                                                  "claim_ce", "cost_center"], exact=True)


@q("p03_correlation")
def _p03(spark, sf):
    return P.correlation(_with_age(claims(spark, sf)), ["quantity", "amount", "age", "label"])


@q("p04_histogram_amount")
def _p04(spark, sf):
    return P.histogram(claims(spark, sf), "amount", 10)


@q("p04_histogram_age")
def _p04b(spark, sf):
    return P.histogram(_with_age(claims(spark, sf)), "age", 10)


@q("p05_provider_counts")
def _p05(spark, sf):
    return P.category_counts(claims(spark, sf), "prov_name")


@q("p07_cost_percentiles")
def _p07(spark, sf):
    return P.cost_percentiles(claims(spark, sf))


def _amount_sketch(spark, sf):
    """Amounts by month and benefit, sketched once and stored."""
    from claimscope.operators import sketches
    from claimscope.plans.stored import data_key, stored
    return stored(spark, f"amount-sketch|{data_key(sf)}", lambda: sketches.build(claims(spark, sf, month=True), "amount", ["claim_month", "benefit"]),
                  sources=T.claim_sources(sf))


@q("p07_sketched_percentiles")
def _p07s(spark, sf):
    """P7 for a period and per benefit, from the stored sketches alone: the
    bounds between which each percentile lies."""
    from claimscope.operators import sketches
    s = _amount_sketch(spark, sf).where(F.col("claim_month").between("1996-01", "1997-06"))
    return (sketches.quantiles(s, D.COST_PERCENTILES, ["benefit"])
            .select("benefit", (F.col("p") * 100).cast("int").alias("pct"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high")))


@q("p08_age_profile")
def _p08(spark, sf):
    return P.age_profile(claims(spark, sf))


# ------------------------------------------------------------------ filters
def _rows(df: DataFrame) -> DataFrame:
    return df.select("line_id", "claim_prov_date", "amount")


@q("f01_period_12m")
def _f01(spark, sf):
    return _rows(Fl.relative_period(claims(spark, sf, month=True), "12m"))


@q("f02_calendar_year")
def _f02(spark, sf):
    return _rows(Fl.calendar_year(claims(spark, sf, month=True), 1998))


@q("f03_last_90_days")
def _f03(spark, sf):
    return _rows(Fl.recent_days(claims(spark, sf, month=True), 90))


@q("f04_date_range")
def _f04(spark, sf):
    return _rows(Fl.date_range(claims(spark, sf, month=True), "1996-02-01", "1996-03-31"))


@q("f05_equals_or_all")
def _f05(spark, sf):
    return _rows(Fl.equals_or_all(claims(spark, sf), benefit="PROMO", prov_name="all",
                                  cost_center="BUILDING"))


@q("f06_amount_range")
def _f06(spark, sf):
    return _rows(Fl.amount_range(claims(spark, sf), 1000, 2500))


@q("f07_member_of")
def _f07(spark, sf):
    return _rows(Fl.member_of(claims(spark, sf), "icd10_code", ["Brand#1", "Brand#13", "Brand#22"]))


@q("f08_custom_filter")
def _f08(spark, sf):
    return Fl.custom_filter(claims(spark, sf, month=True), "1997-01-01", "1998-12-31", 5000, 60000,
                            ["PROMO", "SMALL"], None)


@q("f08_filter_count")
def _f08b(spark, sf):
    return Fl.filter_count(_f08(spark, sf))


@q("f09_risk_level")
def _f09(spark, sf):
    return scored(spark, sf).where(Fl.risk_level("fraud_score") == "Medium").select("line_id", "fraud_score")


@q("f10_score_threshold")
def _f10(spark, sf):
    return Fl.score_at_least(scored(spark, sf), 0.40).select("line_id", "fraud_score")


@q("f11_text_search")
def _f11(spark, sf):
    return Fl.text_search(claims(spark, sf), "brand#2 promo",
                          ["line_id", "icd10_code", "benefit", "prov_name"]).select("line_id")


@q("f14_claim_lookup")
def _f14(spark, sf):
    return Fl.claim_lookup(claims(spark, sf), "7", key="claim_ce").select("line_id", "amount")


_SEARCHED = ["line_id", "icd10_code", "benefit", "prov_name"]


def _index(spark, sf, name, build):
    """A lookup index over the claims, built once and stored."""
    from claimscope.operators.lookup import write_index
    from claimscope.plans.stored import data_key, stored
    return stored(spark, f"index-{name}|{data_key(sf)}", build, write_index, T.claim_sources(sf))


@q("f11_indexed_search")
def _f11i(spark, sf):
    """F11 for a part of a line's id: only the months that hold both terms
    are opened."""
    from claimscope.operators import lookup
    lines = claims(spark, sf, month=True)
    words = lookup.words(lines, _SEARCHED)
    parts = _index(spark, sf, "grams", lambda: lookup.grams(words))
    return lookup.search(lines, words, parts, "115-1- Brand", _SEARCHED).select("line_id", "claim_prov_date", "amount")


@q("f14_indexed_lookup")
def _f14i(spark, sf):
    """F14 by the admission number: only its months are opened."""
    from claimscope.operators import lookup
    lines = claims(spark, sf, month=True)
    ids = _index(spark, sf, "claim-ids", lambda: lookup.id_places(lines, "claim_ce"))
    return lookup.lookup(lines, ids, "7", "claim_ce").select("line_id", "claim_prov_date", "amount")


@q("f15_drilldown")
def _f15(spark, sf):
    return Fl.drilldown(scored(spark, sf))


@q("x_numeric_functions")
def _xnum(spark, sf):
    c = claims(spark, sf)
    return c.select("line_id",
                    X.multiply("quantity", "amount").alias("x_multiply"),
                    X.div("amount", "quantity").alias("x_div"),
                    X.div("amount", F.col("quantity") - F.col("quantity")).alias("x_div_zero"),
                    X.abs_or_zero(F.col("amount") * -1).alias("x_abs"),
                    X.abs_or_zero("benefit").alias("x_abs_bad"),
                    X.abs_or_same("benefit").alias("x_absval_bad"),
                    X.amount_from_text(F.concat(F.lit("KES "), F.col("amount").cast("string"))).alias("x_amount_text"))


@q("x_text_functions")
def _xtext(spark, sf):
    c = claims(spark, sf)
    return c.select("line_id",
                    X.in_list("benefit", " promo, small ").alias("x_in_list"),
                    X.isin_text("cost_center", "building,machinery").alias("x_isin"),
                    X.equals_text("claim_ce", "admit_id").alias("x_equals"),
                    X.mask_member("claim_me").alias("x_mask"),
                    X.default_text(F.when(F.col("quantity") > 25, F.col("quantity"))).alias("x_default"),
                    X.capfirst(F.lower("benefit_desc")).alias("x_capfirst"),
                    X.title("cost_center").alias("x_title"),
                    X.date_text("claim_prov_date", "Y-m").alias("x_ym"),
                    X.date_text("claim_prov_date", "F").alias("x_month_name"),
                    X.money_text("amount").alias("x_money"),
                    X.key_title(F.lower(F.concat_ws("_", "encounter", "gender"))).alias("x_key_title"),
                    X.slice_text("prov_name", 2, -3).alias("x_slice"),
                    X.join_list(X.slice_list(F.array("gender", "encounter", F.when(F.col("quantity") > 25, "many")), -2), "; ").alias("x_join"),
                    X.length_text(F.when(F.col("quantity") > 9, F.col("benefit_desc"))).alias("x_length"),
                    X.upper(F.lower("dependent_type")).alias("x_upper"))


# ------------------------------------------------------------------ order / page / sets
@q("o01_newest_first_top20")
def _o01(spark, sf):
    return Fl.newest_first(claims(spark, sf)).limit(20).select("line_id", "claim_prov_date")


@q("o03_page")
def _o03(spark, sf):
    hr = R.high_risk_claims(scored(spark, sf), THRESHOLD)
    return Fl.page(hr, R.high_risk_order(), size=10, number=2)


@q("o05_selected")
def _o05(spark, sf):
    c = claims(spark, sf)
    ids = Fl.score_at_least(scored(spark, sf), 0.5).select("line_id")
    return Fl.selected(c, ids).select("line_id", "amount")


@q("o06_union_datasets")
def _o06(spark, sf):
    c = claims(spark, sf)
    a = c.where(F.col("claim_prov_date") < F.lit("1998-01-01").cast("date")).select("line_id", "amount")
    b = (c.where(F.col("claim_prov_date") >= F.lit("1998-01-01").cast("date"))
         .select("line_id", "amount", F.col("benefit").alias("dataset_note")))
    return Fl.union_datasets(a, b)


# ------------------------------------------------------------------ aggregates
@q("a01_summary")
def _a01(spark, sf):
    return A.summary(claims(spark, sf))


@q("a02_summary_providers")
def _a02(spark, sf):
    return A.summary_with_providers(claims(spark, sf))


@q("a03_home_summary")
def _a03(spark, sf):
    return A.home_summary(claims(spark, sf))


@q("a04_period_summary")
def _a04(spark, sf):
    return A.period_summary(Fl.calendar_year(claims(spark, sf, month=True), 2000))


@q("a05_overview")
def _a05(spark, sf):
    return A.overview(claims(spark, sf))


@q("a06_by_benefit")
def _a06(spark, sf):
    return A.by_benefit(claims(spark, sf))


@q("a07_top_claimants")
def _a07(spark, sf):
    return A.top_claimants(claims(spark, sf))


@q("a08_top_members_masked")
def _a08(spark, sf):
    return A.top_members_masked(claims(spark, sf))


@q("a09_top_providers")
def _a09(spark, sf):
    return A.top_providers(claims(spark, sf))


@q("a10_amount_by_benefit")
def _a10(spark, sf):
    return A.amount_by(claims(spark, sf), "benefit")


@q("a11_two_level")
def _a11(spark, sf):
    return A.two_level(claims(spark, sf))


@q("a12_claim_frequency")
def _a12(spark, sf):
    return A.claim_frequency(claims(spark, sf))


@q("a13_lorenz")
def _a13(spark, sf):
    return A.lorenz(claims(spark, sf))


@q("a13_gini")
def _a13b(spark, sf):
    return A.gini(claims(spark, sf))


@q("a14_breakdown_sum")
def _a14(spark, sf):
    return A.breakdown(claims(spark, sf), "cost_center", "Sum of Amount", "benefit", ["PROMO", "LARGE"])


@q("a14_breakdown_avg")
def _a14b(spark, sf):
    return A.breakdown(claims(spark, sf), "encounter", "Average Amount")


@q("a15_top_cost_centres")
def _a15(spark, sf):
    return A.top_values(claims(spark, sf), "cost_center", 10)


@q("a16_by_service")
def _a16(spark, sf):
    return A.amount_by(claims(spark, sf), "service_code")


@q("a17_provider_analysis")
def _a17(spark, sf):
    return A.provider_analysis(claims(spark, sf))


@q("a18_diagnosis_treatment")
def _a18(spark, sf):
    return A.diagnosis_treatment(claims(spark, sf))


@q("a19_top_ailments")
def _a19(spark, sf):
    return A.top_values(claims(spark, sf), "ailment", 10)


@q("a20_age_service")
def _a20(spark, sf):
    return A.age_service(claims(spark, sf))


@q("a21_by_gender")
def _a21(spark, sf):
    return A.by_gender(claims(spark, sf))


@q("a22_treatment_distribution")
def _a22(spark, sf):
    return A.treatment_distribution(claims(spark, sf))


@q("a23_provider_efficiency")
def _a23(spark, sf):
    return A.provider_efficiency(claims(spark, sf))


@q("a23_most_efficient")
def _a23b(spark, sf):
    return A.efficiency_extremes(claims(spark, sf), 10, most=True)


@q("a24_break_even")
def _a24(spark, sf):
    return A.break_even(claims(spark, sf), 250000.0, 35.0)


@q("a26_period_breakdown")
def _a26(spark, sf):
    return A.breakdown(Fl.relative_period(claims(spark, sf, month=True), "24m"), "benefit", "Count")


# ------------------------------------------------------------------ temporal
for _unit in ("day", "week", "month", "quarter", "year"):
    def _mk(unit):
        return lambda spark, sf: W.rollup(claims(spark, sf), unit)
    REGISTRY[f"w01_rollup_{_unit}"] = _mk(_unit)


@q("w02_cumulative")
def _w02(spark, sf):
    return W.cumulative(claims(spark, sf), "month")


@q("w03_day_of_week")
def _w03(spark, sf):
    return W.day_of_week(claims(spark, sf))


@q("w04_seasonality")
def _w04(spark, sf):
    return W.seasonality(claims(spark, sf))


@q("w05_hour_of_day")
def _w05(spark, sf):
    return W.hour_of_day(T.events(spark, sf))


@q("w06_monthly_box")
def _w06(spark, sf):
    return W.monthly_box(claims(spark, sf))


@q("w07_heatmap")
def _w07(spark, sf):
    return W.heatmap(claims(spark, sf))


@q("w08_rolling_average")
def _w08(spark, sf):
    return W.rolling_average(claims(spark, sf))


@q("w09_anomalies")
def _w09(spark, sf):
    return W.anomalies(claims(spark, sf))


@q("w10_decomposition")
def _w10(spark, sf):
    return W.decomposition(claims(spark, sf))


@q("w11_weekly_pattern")
def _w11(spark, sf):
    return W.weekly_pattern(claims(spark, sf))


@q("w12_trend_line")
def _w12(spark, sf):
    return W.trend_line(claims(spark, sf))


@q("w13_growth_rate")
def _w13(spark, sf):
    r = W.rollup(claims(spark, sf), "month").select("period", "total_amount")
    return r.withColumn("growth_pct", F.round(W.growth_rate("total_amount", ["period"]), 4))


@q("w14_dense_months")
def _w14(spark, sf):
    return W.dense_months(claims(spark, sf), SERIES_KEYS)


@q("w15_monthly_fraud_trend")
def _w15(spark, sf):
    return R.monthly_fraud_trend(scored(spark, sf), THRESHOLD)


@q("w16_trend_summary")
def _w16(spark, sf):
    return R.trend_summary(scored(spark, sf), THRESHOLD)


@q("w17_member_segments")
def _w17(spark, sf):
    return W.member_segments(claims(spark, sf))


@q("w17_segment_summary")
def _w17b(spark, sf):
    return W.segment_summary(claims(spark, sf))


@q("w18_provider_rank")
def _w18(spark, sf):
    return W.ranked(claims(spark, sf), "prov_name")


# ------------------------------------------------------------------ forecasting
@q("m01_forecast")
def _m01(spark, sf):
    return M.forecast(claims(spark, sf), FORECAST_KEYS, horizon=6, level=95)


@q("m01_forecast_many_series")
def _m01b(spark, sf):
    return M.forecast(claims(spark, sf), SERIES_KEYS, horizon=12, level=90)


@q("m02_ar1_fit")
def _m02(spark, sf):
    f = M.ar1_fit(claims(spark, sf), FORECAST_KEYS)
    return f.select(*FORECAST_KEYS, F.round("coef", 6).alias("coef"),
                    F.round("intercept", 2).alias("intercept"), "n")


def _arima(spark, sf, keys):
    a = M.arima111(claims(spark, sf), keys)
    return a.select(*keys, F.round("ar", 6).alias("ar"), F.round("ma", 6).alias("ma"), F.round("intercept", 2).alias("intercept"), "n",
                    "next_month", F.round("next_amount", 2).alias("next_amount"))


@q("m02_arima111")
def _m02a(spark, sf):
    return _arima(spark, sf, FORECAST_KEYS)


@q("m02_arima111_many_series")
def _m02b(spark, sf):
    return _arima(spark, sf, SERIES_KEYS)


@q("m03_lag_features")
def _m03(spark, sf):
    lf = M.lag_features(claims(spark, sf), FORECAST_KEYS, 3)
    return lf.select(*FORECAST_KEYS, "month", F.round("x", 2).alias("x"),
                     *[F.round(f"lag_{k}", 2).alias(f"lag_{k}") for k in (1, 2, 3)])


@q("m04_accuracy")
def _m04(spark, sf):
    return M.accuracy(claims(spark, sf), FORECAST_KEYS)


@q("m05_forecast_table")
def _m05(spark, sf):
    return M.forecast_table(claims(spark, sf), FORECAST_KEYS, horizon=3)


@q("m05_next_month")
def _m05b(spark, sf):
    return M.next_month(claims(spark, sf), FORECAST_KEYS)


@q("m06_fitted_band")
def _m06(spark, sf):
    h = M.fitted(claims(spark, sf), FORECAST_KEYS, level=99)
    return h.select(*FORECAST_KEYS, "month", F.round("y", 2).alias("amount"),
                    F.round("fit", 2).alias("fit"), F.round("lower", 2).alias("lower"),
                    F.round("upper", 2).alias("upper"))


@q("m07_band_summary")
def _m07(spark, sf):
    return M.band_summary(claims(spark, sf), FORECAST_KEYS)


@q("m07_outside_band")
def _m07b(spark, sf):
    return M.outside_band(claims(spark, sf), SERIES_KEYS, level=90)


@q("m08_lag_contributions")
def _m08(spark, sf):
    return M.lag_contributions(claims(spark, sf), FORECAST_KEYS)


@q("m09_partial_dependence")
def _m09(spark, sf):
    return M.partial_dependence(claims(spark, sf), FORECAST_KEYS, 10)


def _scenarios(spark):
    return spark.createDataFrame(
        [("baseline", 0.0, 0.0, 0.0), ("higher_copay", 20.0, 0.0, 0.0),
         ("deductible", 0.0, 30.0, -5.0), ("growth", -10.0, -10.0, 15.0)],
        "name string, copay_pct double, deductible_pct double, utilization_pct double")


@q("m10_what_if")
def _m10(spark, sf):
    return M.what_if(claims(spark, sf), _scenarios(spark), ["benefit"])


@q("m11_savings_text")
def _m11(spark, sf):
    w = M.what_if(claims(spark, sf), _scenarios(spark), ["benefit"])
    return w.select("benefit", "scenario", M.savings_text("savings").alias("savings_text"))


# ------------------------------------------------------------------ fraud
@q("r01_iqr_bounds")
def _r01(spark, sf):
    b = R.iqr_bounds(R.claim_totals(claims(spark, sf)), "claim_total")
    return b.select(*[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")])


@q("r02_suspicious_claims")
def _r02(spark, sf):
    return R.suspicious_claims(claims(spark, sf), k=None).orderBy(F.desc("amount"), F.asc("claim_id"))


@q("r03_fraud_statistics")
def _r03(spark, sf):
    return R.fraud_statistics(claims(spark, sf))


@q("r04_rule_score")
def _r04(spark, sf):
    """R4 computed from the claims table each time (not the stored run)."""
    s = score_fresh(spark, sf)
    return s.select("line_id", "fraud_score", *[c for c in s.columns if c.startswith("rule_")])


@q("r05_run_summary")
def _r05(spark, sf):
    return R.run_summary(scored(spark, sf), THRESHOLD)


@q("r06_dashboard_summary")
def _r06(spark, sf):
    return R.dashboard_summary(scored(spark, sf), THRESHOLD)


@q("r07_score_histogram")
def _r07(spark, sf):
    return R.score_histogram(scored(spark, sf))


@q("r08_high_risk")
def _r08(spark, sf):
    return R.high_risk_claims(scored(spark, sf), THRESHOLD).orderBy(*R.high_risk_order())


@q("r08_high_risk_page1")
def _r08b(spark, sf):
    return Fl.page(R.high_risk_claims(scored(spark, sf), THRESHOLD), R.high_risk_order(), 10, 1)


@q("r09_high_risk_details")
def _r09(spark, sf):
    return R.high_risk_claims(scored(spark, sf), THRESHOLD, with_details=True).orderBy(*R.high_risk_order())


@q("r10_provider_fraud")
def _r10(spark, sf):
    return R.provider_fraud(scored(spark, sf), THRESHOLD, "rate")


@q("r12_provider_summary")
def _r12(spark, sf):
    return R.provider_summary(scored(spark, sf), THRESHOLD)


@q("r13_provider_vs_average")
def _r13(spark, sf):
    return R.provider_vs_average(scored(spark, sf), THRESHOLD)


@q("r14_diagnosis_fraud")
def _r14(spark, sf):
    return R.fraud_by(scored(spark, sf), THRESHOLD, "icd10_code")


@q("r15_fraud_by_hour")
def _r15(spark, sf):
    return R.fraud_by_hour(T.events(spark, sf))


@q("r16_by_location")
def _r16(spark, sf):
    return R.fraud_by(scored(spark, sf), THRESHOLD, "prov_location")


@q("r17_by_service")
def _r17(spark, sf):
    return R.fraud_by(scored(spark, sf), THRESHOLD, "service_code")


@q("r18_region_hotspots")
def _r18(spark, sf):
    return R.fraud_by(scored(spark, sf), THRESHOLD, "prov_region")


@q("r19_provider_mean_risk")
def _r19(spark, sf):
    return R.provider_mean_risk(scored(spark, sf))


@q("r20_risk_by_benefit")
def _r20a(spark, sf):
    return R.risk_by(scored(spark, sf), "benefit")


@q("r20_risk_by_gender")
def _r20b(spark, sf):
    return R.risk_by(scored(spark, sf), "gender")


@q("r20_risk_by_month")
def _r20c(spark, sf):
    return R.risk_by(scored(spark, sf), "month")


@q("r20_amount_by_risk_level")
def _r20d(spark, sf):
    return R.amount_by_risk_level(scored(spark, sf))


@q("r21_potential_cases")
def _r21(spark, sf):
    return R.potential_cases(scored(spark, sf, month=True), decisions(spark, sf), start="1996-01-01",
                             end="2000-12-31", level="Medium").orderBy(*R.high_risk_order())


@q("r22_review_status")
def _r22(spark, sf):
    return R.with_review_status(scored(spark, sf), decisions(spark, sf)).groupBy("status").agg(
        F.count(F.lit(1)).alias("line_count"))


# ------------------------------------------------------------------ machine learning
_MODELS: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf):
    """The three fraud classifiers, trained once per application and data
    set; the metric, best-model, importance and prediction queries share
    them (the training itself runs on Spark)."""
    from claimscope.operators import ml as L
    from claimscope.plans.stored import data_key
    key = (spark.sparkContext.applicationId, data_key(sf))
    if key not in _MODELS:
        _MODELS[key] = L.fit_models(claims(spark, sf))
    return _MODELS[key]


def _metrics(spark, sf):
    """Metrics of the three classifiers, evaluated once per application."""
    from claimscope.operators import ml as L
    from claimscope.plans.stored import data_key, stored
    return stored(spark, f"l01-metrics|{data_key(sf)}", lambda: L.evaluate(*_fitted(spark, sf)), sources=T.claim_sources(sf))


def _linear(spark, sf):
    """The stored linear classifier: fitted by the first caller, then read."""
    from claimscope.operators import ml as L
    from claimscope.plans.stored import data_key, stored
    return L.Fit.of(stored(spark, f"linear-fit|{data_key(sf)}", lambda: L.fit_linear_classifier(claims(spark, sf)).frame(spark), sources=T.claim_sources(sf)))


@q("l01_train_metrics")
def _l01(spark, sf):
    return _metrics(spark, sf)


@q("l03_linear_metrics")
def _l03(spark, sf):
    from claimscope.operators import ml as L
    return L.linear_metrics(_linear(spark, sf), claims(spark, sf))


@q("l02_binary_target")
def _l02(spark, sf):
    from claimscope.operators import ml as L
    c = claims(spark, sf).drop("label")
    return L.binary_target(c, "amount", 0.75).groupBy("label").agg(F.count(F.lit(1)).alias("line_count"))


@q("l04_best_model")
def _l04(spark, sf):
    from claimscope.operators import ml as L
    return L.best_model(_metrics(spark, sf))


@q("l05_robust_z")
def _l05(spark, sf):
    from claimscope.operators import ml as L
    return L.anomaly_summary(L.robust_z(claims(spark, sf), "amount"), "robust_z")


@q("l05_kmeans_distance")
def _l05b(spark, sf):
    from claimscope.operators import ml as L
    s = L.kmeans_distance(claims(spark, sf))
    return s.agg(F.lit("kmeans").alias("detector"),
                 F.round(F.avg("anomaly_score"), 6).alias("anomaly_score_mean"),
                 F.round(F.stddev_samp("anomaly_score"), 6).alias("anomaly_score_std"),
                 F.count_if("is_anomaly").alias("n_anomalies"))


@q("l06_feature_importance")
def _l06(spark, sf):
    from claimscope.operators import ml as L
    models, test = _fitted(spark, sf)
    return L.feature_importance(models, test)


@q("l06_permutation_importance")
def _l06p(spark, sf):
    """L6 of the stored linear classifier over its held-out lines."""
    from claimscope.operators import ml as L
    _, test = L.split(L.raw_inputs(claims(spark, sf)))
    inputs = [*L.NUMERIC, *L.CATEGORICAL]
    return L.permutation_importance(_linear(spark, sf).predict(), test.select("line_id", "label", *inputs), inputs).select(
        "feature", F.round("importance", 6).alias("importance"), "rows")


@q("l07_class_balance")
def _l07(spark, sf):
    from claimscope.operators import ml as L
    return L.class_balance(claims(spark, sf))


@q("l08_claims_regression")
def _l08(spark, sf):
    from claimscope.operators import ml as L
    return L.train_claims_regression(claims(spark, sf))


@q("m02_pooled_ar3")
def _m02p(spark, sf):
    from claimscope.operators import ml as L
    return L.pooled_ar(M.lag_features(claims(spark, sf), SERIES_KEYS, 3), 3).select("term", F.round("coefficient", 4).alias("coefficient"))


@q("m12_claim_predictions")
def _m12(spark, sf):
    from claimscope.operators import ml as L
    return L.predict_linear(L.fit_linear_classifier(claims(spark, sf)), claims(spark, sf))


@q("m13_batch_predict")
def _m13(spark, sf):
    """The stored model, loaded and applied."""
    from claimscope.operators import ml as L
    return L.predict_linear(_linear(spark, sf), claims(spark, sf))


# ------------------------------------------------------------------ streaming
@q("st_w01_daily_event_rollup")
def _stream(spark, sf):
    from claimscope.streaming.daily_rollup import run_daily_rollup
    return run_daily_rollup(spark, f"{sf.rstrip('/')}/events*.parquet")


@q("w01_daily_event_rollup_batch")
def _stream_batch(spark, sf):
    e = T.events(spark, sf)
    return (e.groupBy(F.col("ts").cast("date").alias("day"), "event_type")
            .agg(F.count(F.lit(1)).alias("event_count"), F.round(F.sum("value"), 4).alias("total_value")))


# ------------------------------------------------------------------ CSV import round trip
@q("s01_csv_import_roundtrip")
def _s01(spark, sf):
    """The claims table exported in the source
    CSV layout, then imported by the import job."""
    import uuid
    from claimscope.session import scratch_path
    from claimscope.sources.csv_import import export_source_csv, import_claims
    path = export_source_csv(claims(spark, sf), scratch_path(spark, f"csv-{uuid.uuid4().hex}"), compression="gzip")
    typed, _ = import_claims(spark, path)
    return typed


@q("a18_diagnosis_treatment_wide")
def _a18w(spark, sf):
    return A.diagnosis_treatment(claims(spark, sf), wide=True)


@q("w07_heatmap_wide")
def _w07w(spark, sf):
    return W.heatmap_wide(claims(spark, sf))


@q("a23_least_efficient")
def _a23c(spark, sf):
    return A.efficiency_extremes(claims(spark, sf), 10, most=False)


@q("m07_outside_band_count")
def _m07c(spark, sf):
    o = M.outside_band(claims(spark, sf), SERIES_KEYS, level=90)
    return o.groupBy(*SERIES_KEYS).agg(F.count(F.lit(1)).alias("months_outside"))


@q("c06_clean_dirty_claims")
def _c06(spark, sf):
    """C5 + C6 over claims with missing values, a sparse column and repeated
    rows."""
    from claimscope.operators.clean import clean
    n = F.col("quantity")
    dirty = claims(spark, sf).select(
        F.when(n % 9 != 0, F.col("claim_prov_date")).alias("claim_prov_date"), F.when(n % 11 != 0, F.col("amount")).alias("amount"),
        "icd10_code", F.when(n == 50, F.col("claim_pod")).alias("mostly_missing"))
    return clean(dirty)


@q("x_map_functions")
def _xmap(spark, sf):
    """A25 over maps of maps built from the claims."""
    per = (claims(spark, sf).groupBy("encounter", "service_code").agg(F.sum("amount").cast("double").alias("total")))
    maps = per.groupBy("encounter").agg(F.map_from_entries(F.collect_list(F.struct(
        "service_code", F.create_map("service_code", "total")))).alias("m"))  # one entry for each service code
    return maps.select("encounter", F.round(X.dict_sum("m", "F-1"), 2).cast("decimal(22,2)").alias("f1_total"),
                       X.length_list("m").cast("long").alias("services"))


@q("x_collection_functions")
def _xcoll(spark, sf):
    """X6-X9 over maps of maps: lines per benefit by cost centre and gender."""
    c = claims(spark, sf)
    per = c.groupBy("benefit", "cost_center").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gender") == "M").alias("men"))
    # at most a cell for each pair of codes; sorted, so that keys have an order
    cells = F.sort_array(F.collect_list(F.struct("cost_center", "n", "men")))
    rows = per.groupBy("benefit").agg(cells.alias("c"))
    flat = rows.select("benefit", F.map_from_entries(F.transform("c", lambda x: F.struct(x.cost_center, x.n))).alias("n"),
                       F.map_from_entries(F.transform("c", lambda x: F.struct(x.cost_center, F.create_map(x.cost_center, x.n.cast("double"), F.lit("men"), x.men.cast("double"))))).alias("nested"),
                       F.transform("c", lambda x: x.men).alias("men"))
    return flat.select("benefit", X.get_item("n", "BUILDING").alias("building"), X.get_item("n", "none such").alias("absent"),
                       X.join_list(X.get_keys("n"), "|").alias("keys"),
                       X.join_list(F.transform(X.to_matrix("nested"), lambda r: X.join_list(F.transform(r, lambda v: v.cast("long")), " ")), "/").alias("matrix"),
                       X.join_list(F.transform(X.zip_lists(X.get_keys("n"), "men"), lambda z: F.concat_ws("=", z["0"], z["men"])), "|").alias("pairs"))


def _dirty_source(spark, sf) -> str:
    """The claims exported as a source file with faults of every kind, each by
    the quantity of the line; unquoted, so that a comma in a field makes a line
    too long."""
    import uuid
    from claimscope.session import scratch_path
    from claimscope.sources.csv_import import compressed
    c = claims(spark, sf)
    cols = {n: F.col(d).cast("string") for n, d in D.CSV_HEADER_MAP}
    fault = F.col("quantity") % 10
    cols["CLAIM_PROV_DATE"] = F.date_format("claim_prov_date", "dd/MM/yyyy")
    cols["DOB"] = F.when(fault == 6, "31/02/1980").otherwise(F.date_format("dob", "dd/MM/yyyy"))
    cols["AMOUNT"] = F.when(fault == 3, "abc").when(fault == 8, "99999999999999").otherwise(cols["AMOUNT"])
    cols["CLAIM_PROV_DATE"] = F.when(fault == 4, F.date_format("claim_prov_date", "yyyy-MM-dd")).otherwise(cols["CLAIM_PROV_DATE"])
    cols["QUANTITY"] = F.when(fault == 5, F.concat(F.lit("x"), cols["QUANTITY"])).otherwise(cols["QUANTITY"])
    cols["BENEFIT_DESC"] = F.when(fault == 7, F.concat(cols["BENEFIT_DESC"], F.lit(",more"))).otherwise(cols["BENEFIT_DESC"])
    path = scratch_path(spark, f"dirty-{uuid.uuid4().hex}")
    c.select(*[v.alias(n) for n, v in cols.items()]).write.option("header", True).option("encoding", "ISO-8859-1").option("quote", "\u0000").options(**compressed("gzip")).csv(path)
    return path


@q("c03_rejects")
def _c03(spark, sf):
    """C3 over the whole claims with faults of every kind."""
    from claimscope.sources.csv_import import import_claims
    _, bad = import_claims(spark, _dirty_source(spark, sf))
    return bad.select(F.col("ADMIT_ID").alias("admit_id"), "field", F.when(F.col("field").isNotNull(), F.col("value")).alias("value"), "reason")


@q("c03_accepted")
def _c03b(spark, sf):
    """S3 of the same file: lines of the right length are claims."""
    from claimscope.sources.csv_import import import_claims
    typed, _ = import_claims(spark, _dirty_source(spark, sf))
    return typed.groupBy("benefit").agg(F.count(F.lit(1)).alias("lines"), F.count("quantity").alias("quantities"), F.count("dob").alias("births"),
                                        F.count("claim_prov_date").alias("dates"), F.sum("amount").cast("decimal(22,2)").alias("total_amount"))


def _accented(c: DataFrame) -> DataFrame:
    return c.withColumns({"prov_name": F.concat(F.lit("Clínica São José n° "), F.col("prov_name")), "pol_name": F.concat(F.lit("Ñandú & Øster "), F.col("pol_name"))})


@q("c10_accents_roundtrip")
def _c10(spark, sf):
    """Latin-1 accents written into the source file and read back."""
    import uuid
    from claimscope.session import scratch_path
    from claimscope.sources.csv_import import export_source_csv, import_claims
    path = export_source_csv(_accented(claims(spark, sf)), scratch_path(spark, f"csv-{uuid.uuid4().hex}"), compression="gzip")
    return import_claims(spark, path)[0].select("admit_id", "service_id", "prov_name", "pol_name")


@q("s01_quoted_line_ends")
def _s01q(spark, sf):
    """S1 with line ends, quotes and commas inside quoted fields, files split."""
    import uuid
    from claimscope.session import scratch_path
    from claimscope.sources.csv_import import export_source_csv, import_claims
    odd = claims(spark, sf).withColumn("benefit_desc", F.concat("benefit_desc", F.lit(', "said"\n'), "cost_center", F.lit("\n\"")))
    path = export_source_csv(odd, scratch_path(spark, f"csv-{uuid.uuid4().hex}"))
    return import_claims(spark, path, multi_line=True)[0]


@q("s10_report_bundles")
def _s10(spark, sf):
    """Rows of each result of the downloadable reports."""
    from claimscope.sources.catalog import report_bundle
    s, out = scored(spark, sf), None
    for kind in ("forecast", "fraud", "provider", "member"):
        for name, df in report_bundle(s, kind, THRESHOLD).items():
            one = df.agg(F.lit(kind).alias("bundle"), F.lit(name).alias("result"), F.count(F.lit(1)).alias("rows"))
            out = one if out is None else out.unionByName(one)
    return out


def _with_nulls(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        token = _NULLS.set(True)
        try:
            return REGISTRY[name](spark, sf)
        finally:
            _NULLS.reset(token)
    return run


for _name in WITH_NULLS:
    REGISTRY[f"{_name}_with_nulls"] = _with_nulls(_name)
