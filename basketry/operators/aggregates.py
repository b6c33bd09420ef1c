"""Aggregates: conditional sums, distinct counts, dispersion, correlation,
regression, ratios. Every one is a built-in aggregate, so Spark runs it as a
partial (map-side) plus final hash aggregate: a hot group key is combined in
each task before the shuffle and never gathered row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agg_conditional(df: DataFrame, by: list, outputs: dict, zero: bool = False) -> DataFrame:
    """One pass: ``{out: (predicate, value)}`` -> sum(value where predicate).

    ``zero=True`` counts non-matching rows as 0 (CASE ... ELSE 0), else they
    are NULL and a group without matches gives NULL.
    """
    aggs = []
    for name, (pred, value) in outputs.items():
        v = F.when(pred, value)
        if zero:
            v = v.otherwise(F.lit(0))
        aggs.append(F.sum(v).alias(name))
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs)


def agg_count_distinct(df: DataFrame, by: list, col: str, out: str = "n_distinct") -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(col).alias(out))


def agg_having(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def agg_stddev_cov(df: DataFrame, by: list, x: str, min_cov: float | None = None) -> DataFrame:
    """Sample std, mean and their ratio per group (1-row groups: std NULL).

    Both are cut to decimal(15,5) before dividing, as the reference does.
    """
    g = df.groupBy(*by).agg(F.stddev_samp(x).alias("stdev"), F.avg(x).alias("mean"))
    sd, mu = F.col("stdev").cast("decimal(15,5)"), F.col("mean").cast("decimal(15,5)")
    g = g.withColumn("cov", F.when(mu != 0, sd.cast("double") / mu.cast("double")))
    if min_cov is not None:
        g = g.where(F.col("cov") >= F.lit(min_cov))
    return g


def agg_corr(df: DataFrame, x: str, y: str, by: list | None = None, out: str = "corr") -> DataFrame:
    g = df.groupBy(*by) if by else df
    return g.agg(F.corr(x, y).alias(out))


def agg_linreg(df: DataFrame, by: list, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x per group, over the rows
    where both are present (a one-point or flat-x group gives NULL)."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"))


def agg_ratio_of_totals(df: DataFrame, predicate: Column, x, by: list | None = None) -> DataFrame:
    """part, whole and 100 * part / whole, in one pass."""
    xv = F.col(x) if isinstance(x, str) else x
    g = df.groupBy(*by) if by else df
    g = g.agg(F.sum(F.when(predicate, xv)).alias("part"), F.sum(xv).alias("whole"))
    return g.withColumn("percent", F.try_divide(F.col("part").cast("double"),
                                                F.col("whole").cast("double")) * F.lit(100.0))


def agg_collect_set(df: DataFrame, by: list, item: str, out: str = "items") -> DataFrame:
    """Sorted distinct non-NULL items per group (``array_sort(collect_set)``).

    Use it where the item domain is bounded (categories, page types): the
    set is combined map-side, so no task ever holds more than the domain per
    group, whatever the group's row count. For unbounded members (items of a
    basket, clicks of a session) the jobs use row forms instead: pairs by
    self join, membership by semi join.
    """
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(out))
