"""Fraud and claims models (L1-L8, M2 pooled, M12, M13).

Training, scoring and every metric are distributed: the classifiers are
``pyspark.ml`` estimators, the linear models solve normal equations
(:mod:`claimscope.operators.linear`), a model's predictions of the test set
are written once and its confusion counts and exact AUC are aggregates over
them.  Only the fitted coefficients live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from claimscope import definitions as D
from claimscope.operators.linear import Design, Fit, class_metrics, design, least_squares, regression_metrics
from claimscope.operators.stats import age_years
from claimscope.plans.distributed import quantile_row
from claimscope.plans.stored import cut

NUMERIC = ["quantity", "amount_d", "age"]
CATEGORICAL = ["benefit", "gender", "dependent_type", "encounter", "cost_center"]
SEED = 42
HASH = 1 << 48        # hashes that deal values anew
GROUP_PLACES = 50_000   # places of rows that are dealt in one group
FIT_ROWS = 200_000   # about so many labelled lines at most train a classifier


def features(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """Model inputs from the claims table.  A missing number becomes 0 with a
    ``<name>_missing`` indicator of 1 beside it (a missing category is a
    category of its own), so no line is ever skipped."""
    out = df.withColumn("amount_d", F.col("amount").cast("double")).withColumn(
        "age", age_years("dob", "claim_prov_date").cast("double"))
    for c in numeric:
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("double")).withColumn(
            c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return out


def _inputs(numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    return [*numeric, *[f"{c}_missing" for c in numeric], *categorical]


def _prep(numeric: Sequence[str], categorical: Sequence[str]):
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                        outputCols=[f"{c}_vec" for c in categorical], handleInvalid="keep")
    asm = VectorAssembler(inputCols=[*numeric, *[f"{c}_missing" for c in numeric], *[f"{c}_vec" for c in categorical]],
                          outputCol="features", handleInvalid="error")
    return idx + [ohe, asm]


def classifiers() -> dict[str, object]:
    """L1: the chosen model set."""
    return {
        "logistic_regression": LogisticRegression(labelCol="label", maxIter=50, regParam=0.01),
        "random_forest": RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=SEED),
        "gradient_boosting": GBTClassifier(labelCol="label", maxIter=15, maxDepth=4, seed=SEED),
    }


def binary_target(df: DataFrame, col: str, pct: float = 0.75) -> DataFrame:
    """L2: continuous target -> 1 above its ``pct`` percentile, else 0."""
    cut = F.broadcast(quantile_row(df, col, {"__cut": pct}))
    return df.crossJoin(cut).withColumn(
        "label", (F.col(col).cast("double") > F.col("__cut")).cast("int")).drop("__cut")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Sample size, positives, class ratio in percent."""
    return df.agg(F.count(F.lit(1)).alias("sample_size"),
                  F.sum(F.col(label).cast("long")).alias("positives"),
                  (F.lit(100.0) * F.sum(F.col(label).cast("long")).cast("double")
                   / F.count(F.lit(1))).alias("positive_pct"))


def dice(df: DataFrame, key: str = "line_id"):
    """0 to 9999 by a hash of ``key``, of all columns where it is missing."""
    own = F.col(key) if key in df.columns else F.to_json(F.struct(*df.columns))
    return F.conv(F.substring(F.md5(own.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000


def split(df: DataFrame, test_fraction: float = 0.3, key: str = "line_id"):
    """Train and test rows by a hash of ``key``: the same row falls on the same
    side whatever the partitioning."""
    test = F.coalesce(dice(df, key) < int(test_fraction * 10_000), F.lit(False))
    return df.where(~test), df.where(test)


def fit_models(df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL,
               models: dict | None = None, fit_rows: int = FIT_ROWS):
    """L1: fit each classifier; returns ``{name: pipeline}`` and the held-out
    test set.  Lines without a label are left out.  Of more than ``fit_rows``
    train lines a sample of about that size, by hash, is fitted; the test set
    is always whole.  The preparation is fitted once; the prepared train set
    and the test set are written once for all models."""
    data = features(df, numeric).where(F.col("label").isNotNull())
    keyed = ["line_id"] if "line_id" in data.columns else []
    train, test = split(data.select(*keyed, *_inputs(numeric, categorical), F.col("label").cast("double").alias("label")))
    share = fit_rows / max(1, train.count())
    if share < 1:
        own = F.xxhash64(*([F.col("line_id")] if keyed else train.columns), F.lit(SEED))
        train = train.where(F.pmod(own, F.lit(1_000_000)) < int(share * 1_000_000))
    prep = Pipeline(stages=_prep(numeric, categorical)).fit(train)
    ready = cut(prep.transform(train).select("features", "label"), "l01-train")
    return {name: PipelineModel([*prep.stages, est.fit(ready)]) for name, est in (models or classifiers()).items()}, cut(test, "l01-test")


def predictions(model: PipelineModel, test: DataFrame) -> DataFrame:
    """``(label, score, prediction)`` of a model, written once."""
    score = vector_to_array("probability")[1]
    return cut(model.transform(test).select("label", score.alias("score"), "prediction"), "l01-predictions")


def evaluate(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """L3: accuracy, precision, recall, f1 and the exact ROC AUC per model,
    from its written predictions."""
    out = None
    for name, m in models.items():
        row = class_metrics(predictions(m, test)).select(
            F.lit(name).alias("model"), *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
            F.lit(False).alias("is_anomaly_detection"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else test.sparkSession.createDataFrame([], "model string")


def best_model(metrics: DataFrame) -> DataFrame:
    """L4: highest F1, then AUC, then name."""
    return metrics.orderBy(F.desc("f1"), F.desc_nulls_last("roc_auc"), F.asc("model")).limit(1)


# ---------------------------------------------------------------- linear classifier
def raw_inputs(df: DataFrame) -> DataFrame:
    """Model inputs with missing numbers left null (the design marks them)."""
    return df.withColumn("amount_d", F.col("amount").cast("double")).withColumn("age", age_years("dob", "claim_prov_date").cast("double"))


def fit_linear_classifier(df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> Fit:
    """L1: linear probability model on the train lines, from one aggregate."""
    train, _ = split(raw_inputs(df).where(F.col("label").isNotNull()))
    return least_squares(train, design(train, numeric, categorical), F.col("label"))


def linear_metrics(fit: Fit, df: DataFrame) -> DataFrame:
    """L3 of the linear classifier over the held-out lines."""
    _, test = split(raw_inputs(df).where(F.col("label").isNotNull()))
    scored = cut(test.select(F.col("label").cast("double").alias("label"), fit.predict().alias("score"))
                 .withColumn("prediction", (F.col("score") >= 0.5).cast("double")), "l03-predictions")
    return class_metrics(scored).select(F.lit("linear_probability").alias("model"),
                                        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")], "tp", "fp", "fn", "tn")


def permutation_importance(score, df: DataFrame, features: Sequence[str], label: str = "label", key: str = "line_id", places: int = GROUP_PLACES) -> DataFrame:
    """L6 for any model: ``feature, importance, rows``, the loss of accuracy on
    ``df`` when one feature's values are dealt anew among the rows.  ``score``
    is a Column over ``df`` (1 from 0.5 up).  The dealing is a permutation keyed
    by hashes of ``key``: the row at place i of one hash order gets the value of
    the row at place i of another, so the same rows are always dealt alike (rows
    without a key come last, in any order).

    Counts by buckets of the hashes tell between which places a row lies.  A row
    goes to the group of these places once for its own place and once for each
    feature, with that feature's value alone and packed; groups have about
    ``places`` places, and what the edge of two groups cuts goes to both.  There
    the exact places are numbered and the values meet, so no task orders all
    rows and all features are dealt in one move."""
    from claimscope.plans.packed import Field, Packing
    data = cut(df.where(F.col(label).isNotNull()), "l06-test")
    n, orders = data.count(), ["to", *features]
    groups = max(1, n // places)
    size, buckets = max(1, -(-n // groups)), 16 * groups

    def hashed(text, seed):
        return F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), seed).cast("binary")), 1, 12), 16, 10).cast("long")

    own = lambda seed: F.xxhash64(seed, *data.columns).bitwiseAND(F.lit(HASH - 1)) + F.lit(HASH)  # noqa: E731  without a key
    seeds = list(map(F.lit, orders))
    dealt = data.select("*", F.posexplode(F.array(*[F.coalesce(hashed(F.col(key).cast("string"), x), own(x)) for x in seeds])).alias("__order", "__hash"))
    dealt = dealt.withColumn("__bucket", F.shiftright(F.shiftright("__hash", 20) * F.lit(buckets), 28))
    counts = dealt.groupBy("__order", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__order").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = lambda place: F.floor(place / F.lit(size))
    start = F.coalesce(F.sum("__n").over(before), F.lit(0))
    cells = cut(counts.withColumn("__start", start).select(
        "__order", "__bucket", "__start", F.sequence(group(F.col("__start")), group(F.col("__start") + F.col("__n") - 1)).alias("__groups")), "l06-buckets")
    begin = cells.select("__order", F.explode("__groups").alias("__group"), "__start").groupBy("__order", "__group").agg(F.min("__start").alias("__start"))

    at = {c: orders.index(c) for c in features}
    value = lambda c: F.when((F.col("__order") == 0) | (F.col("__order") == at.get(c, 0)), F.col(c)).alias(c)
    rows = (dealt.join(F.broadcast(cells.drop("__start")), ["__order", "__bucket"])
            .select(F.explode("__groups").alias("__group"), "__order", F.when(F.col(key).isNull(), F.col("__hash")).alias("__hash"), F.col(key).alias("__key"), *[value(c) for c in data.columns if c != key]))
    carry = (Packing.fit(data, [c for c in features if data.schema[c].dataType == StringType()])
             | Packing({"__order": Field(IntegerType(), 0, len(features)), "__hash": Field(LongType(), 0, 2 * HASH)}))
    moved = carry.values(carry.through(carry.numbers(rows), ["__group"], lambda r: r.repartition("__group")))
    moved = moved.withColumn("__hash", F.coalesce(hashed(F.col("__key").cast("string"), F.get(F.array(*seeds), F.col("__order"))), "__hash"))  # follows from the key
    place = F.row_number().over(Window.partitionBy("__group", "__order").orderBy("__hash", "__key"))
    placed = (moved.withColumn("__rank", place).join(F.broadcast(begin), ["__order", "__group"])
              .withColumn("__at", F.col("__start") + F.col("__rank") - 1).where(group(F.col("__at")) == F.col("__group")))
    one = lambda i, *cols: F.first(F.when(F.col("__order") == i, F.struct(*cols)), ignorenulls=True)
    names = [c for c in data.columns if c != key]
    met = placed.groupBy("__group", "__at").agg(one(0, F.col("__key").alias(key), *names).alias("__row"), *[one(i, c).alias(f"__new{i}") for c, i in at.items()])
    # the row itself and, for each feature, the row with the value that it was dealt
    dealings = [F.struct(F.lit(i).alias("__order"), *[(F.col(f"__new{i}")[c] if i == at.get(c) else F.col("__row")[c]).alias(c) for c in data.columns]) for i in range(len(orders))]
    scored = met.select(F.explode(F.array(*dealings)).alias("r")).select("r.*")
    right = F.coalesce((score >= 0.5) == (F.col(label) == 1), F.lit(False))
    counted = scored.select("__order", right.alias("__right")).agg(
        F.count_if(F.col("__order") == 0).alias("rows"), *[F.count_if((F.col("__order") == i) & F.col("__right")).alias(f"__right{i}") for i in range(len(orders))])
    lost = lambda i: F.try_divide((F.col("__right0") - F.col(f"__right{i}")).cast("double"), "rows")
    return counted.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), lost(i).alias("importance")) for c, i in at.items()]))).select("feature", "importance", "rows")


def predict_linear(fit: Fit, df: DataFrame) -> DataFrame:
    """Per line the predicted class and its probability in percent."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit.predict()))
    return raw_inputs(df).select(F.col("line_id").alias("claim_id"), F.col("amount_d").alias("amount"), (p >= 0.5).cast("int").alias("predicted_label"),
                                 F.round(F.greatest(p, 1.0 - p) * 100, 2).alias("confidence_pct"))


def _feature_names(model: PipelineModel, pred_sample: DataFrame) -> list[str]:
    meta = pred_sample.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    return [names.get(i, f"f{i}") for i in range(len(names))]


def feature_importance(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """Importance per model and feature, largest first (tree models:
    ``featureImportances``; linear: |coefficient|)."""
    spark = test.sparkSession
    rows = []
    for name, m in models.items():
        feats = _apply(m.stages[:-1], test.limit(1))
        names = _feature_names(m, feats)
        last = m.stages[-1]
        if hasattr(last, "featureImportances"):
            vals = last.featureImportances.toArray().tolist()
        else:
            vals = [abs(v) for v in last.coefficients.toArray().tolist()]
        rows += [(name, names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    return df.orderBy("model", F.desc("importance"), "feature")


def _apply(stages, df: DataFrame) -> DataFrame:
    for s in stages:
        df = s.transform(df)
    return df


def predict_claims(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Per line the predicted class and its probability in percent."""
    pred = model.transform(features(df).select("line_id", F.col("amount").cast("double").alias("__amount"), *_inputs(NUMERIC, CATEGORICAL)))
    prob = vector_to_array("probability")
    return pred.select(F.col("line_id").alias("claim_id"), F.col("__amount").alias("amount"),
                       F.col("prediction").cast("int").alias("predicted_label"),
                       F.round(F.array_max(prob) * 100, 2).alias("confidence_pct"))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def batch_predict(path: str, df: DataFrame) -> DataFrame:
    """Load a saved pipeline and score new data."""
    return predict_claims(PipelineModel.load(path), df)


# ---------------------------------------------------------------- anomalies
def robust_z(df: DataFrame, col: str = "amount", limit: float = D.ROBUST_Z_LIMIT) -> DataFrame:
    """Robust z = |x - median| / (1.4826 * MAD); anomaly above ``limit``."""
    x = F.col(col).cast("double")
    med = F.broadcast(quantile_row(df, col, {"__med": 0.5}))
    dev = df.crossJoin(med).withColumn("__dev", F.abs(x - F.col("__med")))
    mad = F.broadcast(quantile_row(dev, "__dev", {"__mad": 0.5}))
    return (dev.crossJoin(mad)
            .withColumn("anomaly_score", F.try_divide(F.col("__dev"), F.lit(D.MAD_SCALE) * F.col("__mad")))
            .withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > F.lit(limit), F.lit(False)))
            .drop("__med", "__dev", "__mad"))


def anomaly_summary(scored: DataFrame, name: str) -> DataFrame:
    """anomaly_score_mean, anomaly_score_std, n_anomalies."""
    return scored.agg(F.lit(name).alias("detector"),
                      F.round(F.avg("anomaly_score"), 6).alias("anomaly_score_mean"),
                      F.round(F.stddev_samp("anomaly_score"), 6).alias("anomaly_score_std"),
                      F.count_if("is_anomaly").alias("n_anomalies"))


def spread_centres(k: int) -> list[list[float]]:
    """Starting centres in standardised space: k points on the diagonal of
    the features, from -1 to 1 standard deviations."""
    return [[0.0 if k == 1 else -1.0 + 2.0 * i / (k - 1)] * len(NUMERIC) for i in range(k)]


def lloyd(points: DataFrame, cols: Sequence[str], centres: list[list[float]], rounds: int) -> list[list[float]]:
    """k-means: each round assigns every row to its nearest centre (the first
    of equals) and takes the means, one aggregate of k rows a round; a centre
    without rows stays.  Stops early when nothing moves."""
    for _ in range(rounds):
        means = {r.cluster: [r[c] for c in cols] for r in points.groupBy(_nearest(cols, centres)[0].alias("cluster")).agg(*[F.avg(c).alias(c) for c in cols]).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return centres


def _nearest(cols: Sequence[str], centres: list[list[float]]):
    """Index of the nearest centre and the squared distance to it."""
    far = []
    for c in centres:
        d = F.lit(0.0)
        for x, v in zip(cols, c):
            d = d + (F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v))
        far.append(d)
    low = F.array_min(F.array(*far))
    index = F.lit(None).cast("int")
    for i, d in reversed(list(enumerate(far))):
        index = F.when(d == low, F.lit(i)).otherwise(index)
    return index, low


def kmeans_distance(df: DataFrame, k: int = 4, top_pct: float = 0.99, rounds: int = 10,
                    centres: list[list[float]] | None = None) -> DataFrame:
    """Distance to the nearest k-means centre (standardised numeric
    features, Lloyd rounds from given centres); anomalies are the farthest
    1 %.  A missing number is put at the mean, so that it adds no distance."""
    raw = df.select("line_id", F.col("amount").cast("double").alias("amount_d"), F.col("quantity").cast("double").alias("quantity"),
                    age_years("dob", "claim_prov_date").cast("double").alias("age"))
    unit = raw.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC], *[F.stddev_samp(c).alias(f"s_{c}") for c in NUMERIC]).first()
    scale = {c: (unit[f"m_{c}"] or 0.0, unit[f"s_{c}"] or 1.0) for c in NUMERIC}
    data = cut(raw.select("line_id", *[((F.coalesce(F.col(c), F.lit(m)) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in scale.items()]), "l05-points")
    found = lloyd(data, NUMERIC, centres or spread_centres(k), rounds)
    index, low = _nearest(NUMERIC, found)
    scored = data.select("line_id", index.alias("cluster"), F.sqrt(low).alias("anomaly_score"))
    top = F.broadcast(quantile_row(scored, "anomaly_score", {"__cut": top_pct}))
    return (scored.crossJoin(top).withColumn("is_anomaly", F.col("anomaly_score") > F.col("__cut"))
            .select("line_id", "cluster", "anomaly_score", "is_anomaly"))


# ---------------------------------------------------------------- regression
def train_claims_regression(df: DataFrame, target: str = "amount_d", numeric: Sequence[str] = ("quantity", "age"),
                            categorical: Sequence[str] = ("benefit", "gender", "encounter")) -> DataFrame:
    """Linear regression of a claims column by normal equations; returns
    rmse, r2 and the number of test rows."""
    data = raw_inputs(df)
    data = data.withColumn("target", F.col(target).cast("double")).where(F.col("target").isNotNull())
    train, test = split(data)
    fit = least_squares(train, design(train, numeric, categorical), F.col("target"))
    m = regression_metrics(test.select("target", fit.predict().alias("prediction")))
    return m.select(F.lit("linear_regression").alias("model"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.col("rows").alias("test_rows"))


def pooled_ar(lags: DataFrame, n_lags: int = 3) -> DataFrame:
    """M2 (pooled): one lag-``n`` regression of the differenced monthly value
    over all series (``lag_features`` output), by normal equations."""
    cols = [f"lag_{k}" for k in range(1, n_lags + 1)]
    data = lags.where(F.col("x").isNotNull())
    for c in cols:
        data = data.where(F.col(c).isNotNull())
    shape = Design(tuple(cols))
    fit = least_squares(data, shape, F.col("x"))
    rows = [(t, v) for t, v in zip(shape.names(), fit.coefficients) if not t.endswith("_missing")]
    return lags.sparkSession.createDataFrame(rows, "term string, coefficient double")
