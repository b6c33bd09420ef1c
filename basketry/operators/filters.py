"""Filters and predicates. All are plain Column expressions, so Catalyst can
push them to the Parquet scan (``PushedFilters``) or below joins."""

from __future__ import annotations

import calendar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pred(col: str, op: str, value) -> Column:
    c = F.col(col)
    if op in ("=", "=="):
        return c == F.lit(value)
    if op == "!=":
        return c != F.lit(value)
    if op == "<":
        return c < F.lit(value)
    if op == "<=":
        return c <= F.lit(value)
    if op == ">":
        return c > F.lit(value)
    if op == ">=":
        return c >= F.lit(value)
    if op == "between":
        lo, hi = value
        return c.between(F.lit(lo), F.lit(hi))
    if op == "in":
        return c.isin(list(value))
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    raise ValueError(f"unknown operator {op!r}")


def disjunction(groups) -> Column:
    """OR of AND-groups; each group is a list of (column, op, value)."""
    ands = [reduce(lambda a, b: a & b, [_pred(*p) for p in g]) for g in groups]
    return reduce(lambda a, b: a | b, ands)


def filter_disjunctive(df: DataFrame, groups) -> DataFrame:
    """Keep rows matching any of the AND-groups. Catalyst splits the parts
    that touch one join side below the join."""
    return df.where(disjunction(groups))


def filter_in_list(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def filter_not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def filter_is_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def _ts_bound(day: str, offset_days: int) -> Column:
    return F.to_timestamp_ntz(F.date_add(F.lit(day).cast("date"), offset_days).cast("string"))


def date_range_filter(df: DataFrame, col: str, first: str, last: str) -> DataFrame:
    """``first <= col's day <= last`` (inclusive), as a range on the raw
    column so that the Parquet reader can skip row groups."""
    c = F.col(col)
    if dict(df.dtypes)[col].startswith("timestamp"):
        return df.where((c >= _ts_bound(first, 0)) & (c < _ts_bound(last, 1)))
    return df.where(c.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def month_range(year: int, first: int, last: int) -> tuple[str, str]:
    """First and last day of the months ``first``..``last`` of a year."""
    return f"{year}-{first:02d}-01", f"{year}-{last:02d}-{calendar.monthrange(year, last)[1]:02d}"


def days_around(df: DataFrame, col: str, day: str, before: int = 30, after: int = 30) -> DataFrame:
    """Rows whose day is within [day - before, day + after]; same as
    ``datediff(col, day) BETWEEN -before AND after``, written as a range."""
    c = F.col(col)
    if dict(df.dtypes)[col].startswith("timestamp"):
        return df.where((c >= _ts_bound(day, -before)) & (c < _ts_bound(day, after + 1)))
    d = F.lit(day).cast("date")
    return df.where(c.between(F.date_sub(d, before), F.date_add(d, after)))


def in_subquery(df: DataFrame, key: str, keys_df: DataFrame, keys_col: str | None = None) -> DataFrame:
    """``key IN (SELECT ...)`` as a left semi join (no duplicates, NULLs never match)."""
    kc = keys_col or key
    return df.join(keys_df.select(F.col(kc).alias("_in_key")),
                   F.col(key) == F.col("_in_key"), "left_semi")
