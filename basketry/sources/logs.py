"""Benchmark logs as tables: the `|`-separated run log and free-text query logs.

Run log: first line a heading; 0-based fields 2 = duration in ms, 3 = start,
6 = query number, 8 = phase, 10 = status (``FAILED`` marks a failure).
Query log: a success line reads ``Time taken: <sec> seconds, Fetched: <n>
row(s)``; a failure line begins ``FAILED: ``. One log per query; the query
name is the ``query`` partition folder (``query=<name>``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the log formats: run-log field positions (0-based) and
# width, the query-log success line pattern and the failure line prefix.
RUNLOG_FIELDS = {"duration_ms": 2, "start": 3, "query": 6, "phase": 8, "status": 10}
RUNLOG_WIDTH = 11
SUCCESS_RE = r"Time taken: ([0-9.]+) seconds, Fetched: ([0-9]+) row"
FAILURE_PREFIX = "FAILED: "


def scan_runlog(spark: SparkSession, path: str) -> DataFrame:
    """(query, phase, duration_ms, start, status, failed) from run-log text."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(RUNLOG_WIDTH)])
    raw = (spark.read.schema(schema).option("sep", "|").option("header", True)
           .option("enforceSchema", True).option("quote", "\u0000").csv(path))
    rows = raw.select(*[F.col(f"c{i}").alias(n) for n, i in RUNLOG_FIELDS.items()])
    return rows.select(
        F.col("query").try_cast("int").alias("query"),
        F.col("phase"),
        F.col("duration_ms").try_cast("long").alias("duration_ms"),
        F.col("start"),
        F.col("status"),
        F.coalesce(F.col("status") == "FAILED", F.lit(False)).alias("failed"))


def scan_querylog(spark: SparkSession, path: str) -> DataFrame:
    """(query, status, seconds, rows) per log line that reports an outcome;
    seconds and rows are NULL on failures (rows as double, like seconds)."""
    raw = spark.read.text(path)
    ok = F.regexp_extract(F.col("value"), SUCCESS_RE, 1)
    fail = F.col("value").startswith(FAILURE_PREFIX)
    x = raw.select(F.col("query").cast("string").alias("query"), F.col("value"),
                   ok.alias("_sec"), F.regexp_extract(F.col("value"), SUCCESS_RE, 2).alias("_rows"),
                   fail.alias("_fail"))
    x = x.where((F.col("_sec") != "") | F.col("_fail"))
    return x.select(
        "query",
        F.when(F.col("_fail"), F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.when(~F.col("_fail"), F.col("_sec").try_cast("double")).alias("seconds"),
        F.when(~F.col("_fail"), F.col("_rows").try_cast("double")).alias("rows"))
