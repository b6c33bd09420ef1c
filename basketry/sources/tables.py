"""Columnar table scans and the retail role bindings of the test tables.

A scan is lazy; selecting columns here (or later) reaches the Parquet reader
as ``ReadSchema`` and filters reach it as ``PushedFilters``.

Role bindings (retail meaning of the driver tables):

* sale line  = lineitem (ticket = l_orderkey, item = l_partkey,
  store/warehouse = l_suppkey, channel store/web = l_linestatus F/O,
  returned = l_returnflag 'R', return day = l_shipdate)
* ticket     = orders (customer = o_custkey, day = o_orderdate)
* item       = part (category = p_type, class = p_brand, price = p_retailprice)
* click      = events (user_id, ts, page type = event_type, item = props.k)
* review     = documents (+ labels)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Dimension tables whose row count is fixed by definition (not by scale):
# these are the only tables we hint for broadcast unconditionally.
FIXED_SIZE_DIMS = {"region": 5, "nation": 25}


def scan_columnar(spark: SparkSession, sf_dir: str, table: str,
                  fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """Read one table of a data folder; only ``columns`` if given."""
    df = spark.read.format(fmt).load(f"{sf_dir.rstrip('/')}/{table}.{fmt}")
    if columns:
        df = df.select(*columns)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = scan_columnar(spark, sf_dir, name, columns=list(columns) or None)
    if name in FIXED_SIZE_DIMS:
        df = F.broadcast(df)
    return df


def money(c: str | Column) -> Column:
    """Money as decimal(15,2) so that sums are exact in every engine."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(15,2)")


def day(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("date")


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (timestamp_ntz or date)
    column, independent of the session time zone."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"),
                            col.cast("timestamp_ntz"))


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock column (zone-free)."""
    return F.floor(epoch_micros(c) / F.lit(1_000_000)).cast("long")


def clicks(spark: SparkSession, sf_dir: str, first: str | None = None, days: int = 0) -> DataFrame:
    """Click stream: user, time (micros), page type, item, value; with
    ``first``, only the ``days`` days from that day (a range on the raw column,
    pushed to the reader).

    ``item`` is the ``k`` field of the JSON ``props`` (NULL if that is no whole
    number); ``event_id`` is the unique tie-break for equal times.
    """
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id",
              "event_type", "value", "props")
    if first is not None:
        day = F.lit(first).cast("date")
        e = e.where((F.col("ts") >= F.to_timestamp_ntz(day.cast("string")))
                    & (F.col("ts") < F.to_timestamp_ntz(F.date_add(day, days).cast("string"))))
    return e.select(
        "event_id", "user_id", "event_type", "value",
        epoch_micros("ts").alias("ts_us"),
        F.get_json_object("props", "$.k").try_cast("long").alias("item"),
    )


def sale_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem with the columns most queries use (pruned by Catalyst)."""
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
            "l_shipdate", *extra]
    return table(spark, sf_dir, "lineitem", *dict.fromkeys(cols))


def net_paid(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """extendedprice * (1 - discount), exact decimal."""
    return money(price) * (F.lit(1) - money(discount))
