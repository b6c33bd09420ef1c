"""Run-log jobs (re-aimed from a spreadsheet report) and result validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.delimited import ctas_temp


def runs_minutes(runs: DataFrame) -> DataFrame:
    """Duration in minutes, 3 decimals, rounded half up on the exact
    millisecond count (integer arithmetic, so no binary-fraction ties)."""
    milli_minutes = F.expr("(duration_ms * 1000 + 30000) div 60000")
    return runs.withColumn("minutes", milli_minutes / F.lit(1000.0))


def runs_average(runs: DataFrame) -> DataFrame:
    """Mean duration (ms and minutes) per (phase, query) over its successful
    repeats, however many; rounded once, at the end."""
    g = runs.where(~F.col("failed")).groupBy("phase", "query").agg(
        F.count(F.lit(1)).alias("repeats"),
        (F.sum("duration_ms").cast("double") / F.count(F.lit(1))).alias("avg_ms"))
    return g.withColumn("avg_minutes", F.round(F.col("avg_ms") / F.lit(60000.0), 3))


def runs_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Averages of run set A vs B per (phase, query): 100 * (B - A) / A
    (the reference report's formula; its heading says (B-A)/B)."""
    aa = runs_average(a).select("phase", "query", F.col("avg_ms").alias("a_ms"))
    bb = runs_average(b).select("phase", "query", F.col("avg_ms").alias("b_ms"))
    return (aa.join(bb, ["phase", "query"])
              .withColumn("change_percent",
                          F.round(F.try_divide(F.lit(100.0) * (F.col("b_ms") - F.col("a_ms")),
                                               F.col("a_ms")), 6)))


def runs_failures(runs: DataFrame) -> DataFrame:
    """Failed runs: (phase, query, status, start)."""
    return runs.where(F.col("failed")).select("phase", "query", "status", "start")


def runs_engines(runs: DataFrame, engines: list[str]) -> DataFrame:
    """Mean successful duration per query, one column per engine (fixed
    pivot values, so no extra pass to find them)."""
    g = runs.where(~F.col("failed")).groupBy("query").pivot("engine", engines).agg(
        F.avg("duration_ms"))
    return g.select("query", *[F.col(e).alias(f"avg_ms_{e}") for e in engines])


RANGES = 1 << 12  # hash ranges that are compared first
PIECE = 22        # bits of a hash that are summed at a time: a long holds the sum of 2^41 of them
BITS = 16         # bits of the bitmap for a hash that differs
MOST_BITS = 1 << 26  # of the whole bitmap (8 MB, a million words)


def _signed(x: DataFrame, y: DataFrame, *cols: str) -> DataFrame:
    return x.select(*cols, F.lit(1).alias("_d")).unionByName(y.select(*cols, F.lit(-1).alias("_d")))


def _differing_ranges(x: DataFrame, y: DataFrame) -> list[int]:
    """Ranges (at most ``RANGES``) whose fingerprints differ between the two sides."""
    pieces = [F.shiftrightunsigned(F.col(c), k).bitwiseAND(F.lit((1 << PIECE) - 1)) for c in ("_h", "_g") for k in range(0, 64, PIECE)]
    sums = _signed(x, y, "_r", "_h", "_g").groupBy("_r").agg(F.sum("_d").alias("n"), *[
        F.sum(F.col("_d") * p).alias(f"s{i}") for i, p in enumerate(pieces)])
    differs = F.col("n") != 0
    for i in range(len(pieces)):
        differs = differs | (F.col(f"s{i}") != 0)
    return sorted(r["_r"] for r in sums.where(differs).select("_r").collect())


def _may_differ(differing: DataFrame):
    """Narrows a frame with ``_g`` to the rows that may be among ``differing`` (a
    written table of hashes): a bitmap of ``BITS`` bits a hash, ``MOST_BITS`` at
    most, is broadcast. It keeps or drops equal rows alike."""
    bits, wanted = 1 << 16, min(MOST_BITS, BITS * differing.count())
    while bits < wanted:
        bits *= 2
    word = F.shiftright(F.col("_g").bitwiseAND(F.lit(bits - 1)), 6)
    bit = F.col("_g").bitwiseAND(F.lit(63)).cast("int")
    words = differing.select(word.alias("_word"), F.expr("shiftleft(1L, cast(_g & 63 as int))").alias("_b")).groupBy("_word").agg(
        F.bit_or("_b").alias("_bits"))
    return lambda t: t.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1)


def result_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that differ between two results, with multiplicity, labelled
    ``side`` = 'extra' (only in actual) or 'missing' (only in expected).
    Empty when the results are equal as multisets.

    Order-free fingerprints (rows counted, two 64-bit row hashes summed) of
    ``RANGES`` hash ranges find where the results differ, so equal results shuffle
    fingerprints alone. In the ranges that differ the rows are counted by their two
    hashes, and only rows that may have hashes of differing counts are shuffled and
    compared as a whole, however many ranges differ. (Ranges or rows that differ but
    agree in all of that would be missed: no such coincidence is expected below
    2^100 comparisons.) Columns of map type can't be hashed and are refused by Spark.
    """
    cols = expected.columns

    def hashed(df):
        # null flags too: a hash passes over nulls
        flags = [F.isnull(c) for c in cols]
        h, g = F.xxhash64(*cols, *flags), F.xxhash64(F.lit("g"), *reversed(cols), *flags)
        return df.select(*cols, h.alias("_h"), g.alias("_g"), F.pmod(h, F.lit(RANGES)).alias("_r"))
    x, y = hashed(actual), hashed(expected)
    ranges = _differing_ranges(x, y)
    x, y = (t.where(F.col("_r").isin(ranges)) for t in (x, y))
    if ranges:
        counted = _signed(x, y, "_h", "_g").groupBy("_h", "_g").agg(F.sum("_d").alias("_d"))
        differing = ctas_temp(expected.sparkSession, counted.where("_d <> 0").select("_h", "_g"), "differing")
        x, y = map(_may_differ(differing), (x, y))
    diff = _signed(x, y, *cols).groupBy(*cols).agg(F.sum("_d").alias("_d")).where(F.col("_d") != 0)
    return diff.select(F.when(F.col("_d") > 0, "extra").otherwise("missing").alias("side"), *cols,
                       F.explode(F.sequence(F.lit(1), F.abs("_d"))).alias("_i")).drop("_i")
