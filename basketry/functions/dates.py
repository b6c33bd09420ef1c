"""Calendar and time-key helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_EPOCH = "1900-01-01"  # a Monday: week_seq counts Monday-to-Sunday weeks from it


def build_date_dim(spark: SparkSession, first, last) -> DataFrame:
    """Calendar: one row per day in [first, last] with day key, year, month,
    day of month, quarter, week sequence and day name. ``first``/``last``
    are date strings or Columns of a one-row frame's values."""
    f = F.lit(first).cast("date") if not isinstance(first, Column) else first
    lo = F.lit(last).cast("date") if not isinstance(last, Column) else last
    days = spark.range(1).select(F.explode(F.sequence(f, lo)).alias("d_date"))
    return date_parts(days, "d_date")


def date_parts(df: DataFrame, col: str) -> DataFrame:
    d = F.col(col)
    return df.select(
        d.alias("d_date"),
        F.datediff(d, F.lit("1970-01-01").cast("date")).alias("d_date_sk"),
        F.year(d).alias("d_year"), F.month(d).alias("d_moy"), F.dayofmonth(d).alias("d_dom"),
        F.quarter(d).alias("d_qoy"),
        F.floor(F.datediff(d, F.lit(WEEK_EPOCH).cast("date")) / 7).cast("int").alias("d_week_seq"),
        F.date_format(d, "EEEE").alias("d_day_name"))


def date_dim_for(df: DataFrame, col: str) -> DataFrame:
    """Calendar spanning the days of ``col`` in ``df`` (bounds from one
    global min/max aggregate; the calendar itself is small)."""
    b = df.agg(F.min(F.col(col).cast("date")).alias("lo"), F.max(F.col(col).cast("date")).alias("hi"))
    days = b.select(F.explode(F.sequence("lo", "hi")).alias("d_date"))
    return date_parts(days, "d_date")


def days_of_weeks(spark: SparkSession, dates: list[str]) -> DataFrame:
    """``day``: all days of the weeks (numbered as ``d_week_seq``) that hold the
    given dates."""
    values = ", ".join(f"(DATE '{d}')" for d in dates)
    d = spark.sql(f"SELECT d FROM VALUES {values} AS t(d)")
    start = F.date_sub("d", F.pmod(F.datediff("d", F.lit(WEEK_EPOCH).cast("date")), F.lit(7)))
    return d.select(F.explode(F.sequence(start, F.date_add(start, 6))).alias("day")).distinct()


def virtual_ts(day_key: Column, second_key: Column) -> Column:
    """day key x 86400 + second of day: one time line in seconds."""
    return day_key.cast("long") * F.lit(86400) + second_key.cast("long")
