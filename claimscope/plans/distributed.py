"""Order statistics without gathering a group into one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer and a window without ``partitionBy`` moves all rows to one
partition.  The helpers here put every number into a *bucket* that never
decreases with it (:func:`order_bucket`), total the buckets, and add the totals
of the buckets before.  The bucket table has at most a few million rows
whatever the data size (a few thousand in practice), so ordering it in one
task is safe; rows are only ever ordered inside their bucket.

Everything is one lazy plan with one path for all sizes: nothing is counted,
collected or written first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E = 4096   # buckets for each factor e of a value: 0.024 % wide
_LOWEST = 746          # exp(-746) is below the smallest positive double
_LAST = 1 << 62


def order_bucket(c: Column) -> Column:
    """A long that never decreases with the number ``c``; nulls and NaN last.
    Buckets are 0.024 % wide for values of any size, so those of rates and
    scores spread like those of amounts.  It lies within
    +-1456 * ``BUCKETS_PER_E`` for every finite double."""
    v = c.cast("double")
    b = F.signum(v) * (F.floor(F.ln(F.abs(v)) * BUCKETS_PER_E) + F.lit(_LOWEST * BUCKETS_PER_E))
    b = F.when(v == 0, F.lit(0)).when(F.abs(v) == F.lit(float("inf")), F.signum(v) * (_LAST >> 1)).otherwise(b)
    return F.when(v.isNull() | F.isnan(v), F.lit(_LAST)).otherwise(b.cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key is a value like any other; without
    keys ``right`` is one row."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    by: Sequence[str] = (), prob_col: str = "p",
                    out_col: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation (the definition of Spark's
    ``percentile``, pandas' default ``quantile`` and DuckDB's
    ``quantile_cont``), per group of ``by`` (null is a group); null values
    ignored.  Returns ``by + [prob_col, out_col]``.

    Rows are counted per distinct (group, value), a map-side combined
    aggregate.  The totals of the value buckets tell in which bucket each
    wanted rank lies (two ranks for a group and probability); only those
    buckets' values are ordered to read the ranks.
    """
    by = list(by)
    v = value if isinstance(value, Column) else F.col(value)
    hist = (df.select(*by, v.cast("double").alias("__v")).where(F.col("__v").isNotNull())
            .groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__w"))
            .withColumn("__b", order_bucket(F.col("__v"))))
    group = Window.partitionBy(*[F.col(c) for c in by])
    cells = (hist.groupBy(*by, "__b").agg(F.sum("__w").alias("__n"))
             .withColumn("__end", F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("__all", F.sum("__n").over(group)))

    def rank(p: float, side: str) -> Column:
        pos = F.lit(p) * (F.col("__all") - 1)
        low = F.floor(pos)
        return F.struct(F.lit(p).alias("p"), F.lit(side).alias("side"), (pos - low).alias("frac"),
                        (low if side == "lo" else F.ceil(pos)).alias("rank"))

    ranks = F.array(*[rank(float(p), side) for p in probs for side in ("lo", "hi")])
    start = F.col("__end") - F.col("__n")
    cells = (cells.withColumn("__hits", F.filter(ranks, lambda r: (r.rank >= start) & (r.rank < F.col("__end"))))
             .where(F.size("__hits") > 0).select(*by, "__b", start.alias("__c0"), "__hits"))
    inside = (Window.partitionBy(*by, "__b").orderBy("__v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (null_safe_join(hist, cells, [*by, "__b"])
              .withColumn("__e", F.col("__c0") + F.sum("__w").over(inside)))
    found = placed.select(*by, "__v", F.explode(F.filter(
        "__hits", lambda r: (r.rank >= F.col("__e") - F.col("__w")) & (r.rank < F.col("__e")))).alias("t"))
    side = lambda s: F.max(F.when(F.col("t.side") == s, F.col("__v")))
    out = found.groupBy(*by, F.col("t.p").alias(prob_col)).agg(
        F.max("t.frac").alias("__frac"), side("lo").alias("__lo"), side("hi").alias("__hi"))
    return out.select(*by, prob_col, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias(out_col))


def quantile_row(df: DataFrame, value: str | Column, probs: dict[str, float],
                 by: Sequence[str] = ()) -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one row per group with one
    column per named probability."""
    long = exact_quantiles(df, value, list(probs.values()), by=by)
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name)
        for name, p in probs.items()])


def running_total(df: DataFrame, order: Sequence[str], values: Sequence[str],
                  suffix: str = "_cum") -> DataFrame:
    """Running sums of ``values`` over a total order of the whole DataFrame
    plus ``row_pos`` (1-based).  ``order`` begins with a number (nulls last)
    and ends in a unique key.

    Equivalent to ``sum(v).over(Window.orderBy(*order))`` with rows framing:
    running sums inside each bucket of the first order column plus the totals
    of the buckets before.  Rows that tie in a bucket are ordered in one
    task's (spilling) sort.
    """
    keys = [F.col(order[0]).asc_nulls_last(), *[F.col(c) for c in order[1:]]]
    rows = df.withColumn("__b", order_bucket(F.col(order[0]))).withColumn("__one", F.lit(1).cast("long"))
    sums = ["__one", *values]
    inside = Window.partitionBy("__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("__b").agg(*[F.sum(c).alias(f"{c}__t") for c in sums])
    cells = cells.select(F.col("__b").alias("__cb"), *[F.coalesce(F.sum(f"{c}__t").over(before), F.lit(0)).alias(f"{c}__o") for c in sums])
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}__l") for c in sums])
    out = local.join(cells, F.col("__b") == F.col("__cb"))
    total = lambda c: F.col(f"{c}__l") + F.col(f"{c}__o")
    return out.select(*df.columns, total("__one").alias("row_pos"), *[total(c).alias(f"{c}{suffix}") for c in values])


def rank_sum_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row ``roc_auc, positives, negatives``: the exact area under the ROC
    curve, the chance that a positive outscores a negative, ties counting half
    (null without both classes).  Rows are first counted per distinct score,
    map-side combined; the negatives below each score are a running total over
    buckets, so no task sees all scores."""
    pos = F.col(label).cast("double") == 1
    cells = (scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("__s"))
             .agg(F.count_if(pos).alias("__pos"), F.count_if(~pos).alias("__neg")))
    ranked = running_total(cells, ["__s"], ["__neg"])
    won = F.col("__pos").cast("decimal(38,0)") * (2 * F.col("__neg_cum") - F.col("__neg"))
    total = ranked.agg(F.sum(won).alias("__won"), F.coalesce(F.sum("__pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("__neg"), F.lit(0)).alias("negatives"))
    return total.select(F.try_divide(F.col("__won").cast("double"), 2.0 * F.col("positives") * F.col("negatives")).alias("roc_auc"), "positives", "negatives")


def dense_rank_desc(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``dense_rank() over (order by value desc nulls last)`` for any number
    of rows: rank the distinct values with :func:`running_total`, join back;
    a null value is ranked last, not lost."""
    distinct = df.select(F.col(value)).distinct().withColumn("__neg", -F.col(value))
    ranked = running_total(distinct, ["__neg"], []).select(value, F.col("row_pos").alias(out))
    return null_safe_join(df, ranked, [value])
