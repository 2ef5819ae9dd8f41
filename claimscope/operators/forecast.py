"""Monthly forecasts, bands, lag models and what-if.

Every step is per series (``keys``, e.g. benefit x provider) and set-based:
the least-squares fit of each series is a grouped ``regr_*`` aggregate, the
forecast months come from ``sequence``, the lag features from windows
partitioned by series.  A series is a few hundred months at most, so the
per-series windows are small however many series there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.operators.linear import grouped_least_squares
from claimscope.operators.temporal import dense_months, month_index
from claimscope.plans.distributed import null_safe_join

MONEY = "decimal(22,2)"


def monthly_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Series table ``keys + [month, y, t]`` with empty months as 0."""
    return (dense_months(df, keys)
            .select(*keys, "month", F.col("amount").cast("double").alias("y"),
                    month_index("month").alias("t")))


def fit_trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: slope, intercept, n, r2 and the residual sd (n - 2)."""
    y, t = F.col("y"), F.col("t")
    return (series.groupBy(*keys)
            .agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"),
                 F.regr_r2(y, t).alias("r2"), F.count(F.lit(1)).alias("n"),
                 F.max("t").alias("last_t"), F.max("month").alias("last_month"),
                 F.regr_syy(y, t).alias("__syy"), F.regr_sxy(y, t).alias("__sxy"),
                 F.regr_sxx(y, t).alias("__sxx"))
            .withColumn("resid_sd", F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0),
                        (F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx"))
                        / (F.col("n") - 2)))))
            .drop("__syy", "__sxy", "__sxx"))


def _z(level: int) -> Column:
    if level not in D.Z_SCORES:
        raise ValueError(f"confidence level must be one of {sorted(D.Z_SCORES)}")
    return F.lit(D.Z_SCORES[level])


def forecast(df: DataFrame, keys: Sequence[str] = (), horizon: int = 6,
             level: int = 95) -> DataFrame:
    """M1 + M6: the next ``horizon`` months per series from the linear trend,
    with a band fit +- z * residual sd."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    fit = fit_trend(monthly_series(df, keys), keys)
    z = _z(level)
    fc = fit.select(*keys, "slope", "intercept", "resid_sd", "last_t", "last_month",
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    f = F.col("intercept") + F.col("slope") * (F.col("last_t") + F.col("step"))
    return fc.select(*keys, F.add_months("last_month", F.col("step")).alias("month"),
                     F.round(f, 2).alias("forecast"),
                     F.round(f - z * F.col("resid_sd"), 2).alias("lower"),
                     F.round(f + z * F.col("resid_sd"), 2).alias("upper"))


def fitted(df: DataFrame, keys: Sequence[str] = (), level: int = 95) -> DataFrame:
    """Actual months with fitted value and band (M6 on history)."""
    s = monthly_series(df, keys)
    fit = fit_trend(s, keys)
    z = _z(level)
    f = F.col("intercept") + F.col("slope") * F.col("t")
    return null_safe_join(s, fit.select(*keys, "slope", "intercept", "resid_sd", "last_month"), keys).select(*keys, "month", "y", f.alias("fit"),
                     (f - z * F.col("resid_sd")).alias("lower"),
                     (f + z * F.col("resid_sd")).alias("upper"), "last_month")


def accuracy(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M4: per series accuracy % = max(0, 100 - MAPE) over fitted months
    with a non-zero actual, R^2 and MAE."""
    h = fitted(df, keys)
    err = F.abs(F.col("y") - F.col("fit"))
    ape = F.when(F.col("y") != 0, err / F.abs(F.col("y")))
    fit = fit_trend(monthly_series(df, keys), keys)
    acc = (h.groupBy(*keys).agg(F.avg(ape).alias("__mape"), F.avg(err).alias("__mae")))
    joined = null_safe_join(acc, fit.select(*keys, "r2"), keys)
    return joined.select(*keys,
                         F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(100.0) * F.col("__mape")), 4).alias("accuracy_pct"),
                         F.round("r2", 6).alias("r2"), F.round("__mae", 2).alias("mae"))


def forecast_table(df: DataFrame, keys: Sequence[str] = (), horizon: int = 6,
                   level: int = 95) -> DataFrame:
    """M5: forecast rows with growth % against the previous month (the last
    actual month for the first step)."""
    fc = forecast(df, keys, horizon, level)
    last = (monthly_series(df, keys).groupBy(*keys)
            .agg(F.max_by("y", "month").alias("__last_y")))
    j = null_safe_join(fc, last, keys)
    w = (Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month"))
    prev = F.coalesce(F.lag("forecast", 1).over(w), F.round("__last_y", 2))
    return j.select(*keys, "month", F.col("forecast").alias("amount"),
                    F.round(F.lit(100.0) * (F.try_divide(F.col("forecast"), F.nullif(prev, F.lit(0.0))) - F.lit(1.0)), 4).alias("growth_pct"),
                    "lower", "upper")


def next_month(df: DataFrame, keys: Sequence[str] = (), level: int = 95) -> DataFrame:
    """M5 summary: next month's forecast, growth and the fit accuracy."""
    t = forecast_table(df, keys, 1, level).select(*keys, F.col("month").alias("next_month"),
                                                 "amount", "growth_pct")
    a = accuracy(df, keys).select(*keys, "accuracy_pct")
    return null_safe_join(t, a, keys)


def band_summary(df: DataFrame, keys: Sequence[str] = (), level: int = 95) -> DataFrame:
    """M7: mean half-width of the band per series."""
    fit = fit_trend(monthly_series(df, keys), keys)
    return fit.select(*keys, F.round(_z(level) * F.col("resid_sd"), 2).alias("half_width"))


def outside_band(df: DataFrame, keys: Sequence[str] = (), level: int = 95,
                 months: int = 12) -> DataFrame:
    """M7: months of the last ``months`` whose actual lies outside the band."""
    h = fitted(df, keys, level)
    return (h.where(F.col("month") > F.add_months("last_month", -months))
            .where((F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper")))
            .select(*keys, F.col("month").alias("date"), F.round("y", 2).alias("amount")))


def lag_features(df: DataFrame, keys: Sequence[str] = (), lags: int = 3,
                 differenced: bool = True) -> DataFrame:
    """M3: lag 1..n of the (first-differenced) monthly series."""
    s = monthly_series(df, keys)
    w = Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month")
    if differenced:
        s = s.withColumn("x", F.col("y") - F.lag("y", 1).over(w))
    else:
        s = s.withColumn("x", F.col("y"))
    for k in range(1, lags + 1):
        s = s.withColumn(f"lag_{k}", F.lag("x", k).over(w))
    return s


def ar1_fit(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M2 (closed form): per series least squares of the differenced value
    on its own lag 1 -- the AR part of ARIMA(1,1,.) without the MA term."""
    lf = lag_features(df, keys, 1).where(F.col("lag_1").isNotNull() & F.col("x").isNotNull())
    return lf.groupBy(*keys).agg(F.regr_slope("x", "lag_1").alias("coef"),
                                 F.regr_intercept("x", "lag_1").alias("intercept"),
                                 F.avg("lag_1").alias("lag_mean"),
                                 F.count(F.lit(1)).alias("n"))


def arima111(df: DataFrame, keys: Sequence[str] = (), long_lags: int = 3) -> DataFrame:
    """M2 with the MA term: ARIMA(1,1,1) of every series by the two regressions
    of Hannan and Rissanen.  A long autoregression (``long_lags`` lags of the
    differenced month) gives residuals; the difference is then regressed on its
    own lag and the lagged residual.  Returns ``keys + [ar, ma, intercept, n,
    next_month, next_amount]``, the last being the one-step forecast of the
    level.  A series too short or without variation has null coefficients (without
    ``keys`` and any full row: no row)."""
    lf = lag_features(df, keys, long_lags)
    lags = [F.col(f"lag_{k}") for k in range(1, long_lags + 1)]
    rows = lf.where(F.col(f"lag_{long_lags}").isNotNull())
    far = grouped_least_squares(rows, keys, [F.lit(1.0), *lags], F.col("x")).select(*keys, "b")
    guess = F.col("b")[0]
    for k, lag in enumerate(lags):
        guess = guess + F.col("b")[k + 1] * lag
    w = Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month")
    left = (null_safe_join(lf, far, keys, "left").withColumn("e", F.col("x") - guess).drop("b")
            .withColumn("e_1", F.lag("e", 1).over(w)))
    near = grouped_least_squares(left.where(F.col("e_1").isNotNull()), keys, [F.lit(1.0), F.col("lag_1"), F.col("e_1")], F.col("x"))
    last = left.groupBy(*keys).agg(F.max_by(F.struct("month", "y", "x", "e"), "month").alias("l"))
    b = F.col("b")
    step = F.col("l.y") + b[0] + b[1] * F.col("l.x") + b[2] * F.col("l.e")
    return null_safe_join(last, near, keys, "left").select(*keys, b[1].alias("ar"), b[2].alias("ma"), b[0].alias("intercept"), "n",
                                                   F.add_months("l.month", 1).alias("next_month"), step.alias("next_amount"))


def lag_contributions(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M8: per month the lag's contribution coef * (x - mean x); for a
    linear model base + contribution = prediction exactly."""
    lf = lag_features(df, keys, 1).where(F.col("lag_1").isNotNull() & F.col("x").isNotNull())
    fit = ar1_fit(df, keys)
    j = null_safe_join(lf, fit, keys)
    pred = F.col("intercept") + F.col("coef") * F.col("lag_1")
    base = F.col("intercept") + F.col("coef") * F.col("lag_mean")
    return j.select(*keys, "month", F.round(pred, 2).alias("prediction"),
                    F.round(base, 2).alias("base_value"),
                    F.round(F.col("coef") * (F.col("lag_1") - F.col("lag_mean")), 2).alias("lag_1_contribution"))


def partial_dependence(df: DataFrame, keys: Sequence[str] = (), points: int = 10) -> DataFrame:
    """M9: mean prediction with lag 1 set to each of ``points`` grid values
    spread evenly from its min to its max (per series)."""
    lf = lag_features(df, keys, 1).where(F.col("lag_1").isNotNull() & F.col("x").isNotNull())
    rng = lf.groupBy(*keys).agg(F.min("lag_1").alias("__lo"), F.max("lag_1").alias("__hi"))
    fit = ar1_fit(df, keys)
    g = null_safe_join(rng, fit, keys)
    grid = g.select(*keys, "coef", "intercept", "__lo", "__hi",
                    F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    val = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("i") / F.lit(float(points - 1))
    return grid.select(*keys, "i", F.round(val, 2).alias("lag_1_value"),
                       F.round(F.col("intercept") + F.col("coef") * val, 2).alias("mean_prediction"))


def what_if(df: DataFrame, scenarios: DataFrame, keys: Sequence[str] = (),
            copay_weight: float = D.COPAY_WEIGHT,
            deductible_weight: float = D.DEDUCTIBLE_WEIGHT) -> DataFrame:
    """Projected cost per group under each scenario (a table of
    ``name, copay_pct, deductible_pct, utilization_pct``):
    current x (1 + u) x (1 - w1 c) x (1 - w2 d).  The scenarios are a
    parameter table (user input, bounded), broadcast to the group totals."""
    for c, lo, hi in (("copay_pct", -100, 100), ("deductible_pct", -100, 100),
                      ("utilization_pct", -50, 50)):
        if c not in scenarios.columns:
            raise ValueError(f"scenarios need {c}")
    cur = df.groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("current_total"))
    sc = scenarios.select(F.col("name").alias("scenario"),
                          *[F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(c).cast("double"))).alias(c)
                            for c, lo, hi in (("copay_pct", -100, 100), ("deductible_pct", -100, 100),
                                              ("utilization_pct", -50, 50))])
    proj = (F.col("current_total").cast("double")
            * (F.lit(1.0) + F.col("utilization_pct") / F.lit(100.0))
            * (F.lit(1.0) - F.lit(copay_weight) * F.col("copay_pct") / F.lit(100.0))
            * (F.lit(1.0) - F.lit(deductible_weight) * F.col("deductible_pct") / F.lit(100.0)))
    out = cur.crossJoin(F.broadcast(sc)).select(*keys, "scenario", "current_total",
                                                 proj.alias("projected_total"))
    return (out.withColumn("savings", F.col("current_total").cast("double") - F.col("projected_total"))
            .withColumn("savings_percent", F.lit(100.0) * F.try_divide(
                F.col("savings"), F.nullif(F.col("current_total").cast("double"), F.lit(0.0)))))


def savings_text(savings: str | Column = "savings") -> Column:
    """The saving as ``KES`` text, only when it is not 0.00."""
    from claimscope.functions.scalar import money_text
    s = F.col(savings) if isinstance(savings, str) else savings
    return F.when(F.round(s, 2) != 0, money_text(s))
