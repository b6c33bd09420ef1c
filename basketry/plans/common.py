"""Shared pieces of the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND_US = 1_000_000
DAY_S = 86_400


def s_to_us(seconds: int) -> int:
    """Click times are microseconds; reference parameters are seconds."""
    return int(seconds) * SECOND_US


def lit_date(d: str):
    return F.lit(d).cast("date")


TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE_TEXT = "yyyy-MM-dd"


def report_types(df: DataFrame) -> DataFrame:
    """Plain result types for a registered job's output: decimals (already
    rounded to their declared scale) as doubles, wall-clock timestamps and
    dates as ISO text with a fixed format. Library functions keep native
    types; only the registered reports are normalised, so that any consumer
    (and the SQL oracle) sees the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, TS_TEXT)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, DATE_TEXT)
        else:
            cols.append(c)
            continue
        cols.append(c.alias(f.name))
    return df.select(*cols)
