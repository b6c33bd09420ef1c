"""Shared pieces of the training-data operators: scratch tables in the shared
folder, distributed running sums, and views on Arrow text columns."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketry.session import scratch_path

# Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Every white-space run that is not one plain space already.
SPACES = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def _free_shuffles(spark: SparkSession):
    """Shuffle files of the enclosed writes go as soon as each write ends: the
    written table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts
    the lineage, survives lost executors, and freezes row ids. The caller's
    ``session.clear_scratch`` deletes what is left once results are written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with _free_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._basketry_path = path
    if _recorded is not None:
        _recorded.append(out)
    return out


_recorded: list[DataFrame] | None = None


@contextmanager
def recording(tables: list[DataFrame]):
    """Tables that ``saved`` writes meanwhile are noted in ``tables``, for
    ``dropped`` once what reads them has been written."""
    global _recorded
    before, _recorded = _recorded, tables
    try:
        yield
    finally:
        _recorded = before


def dropped(df: DataFrame) -> None:
    """Delete a table written by ``saved`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._basketry_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``, which tells the rows apart and is the same at every reading:
    the file and the place in it. Rows that come from no file are written first."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name)
    try:
        out = df.select("*", place)
        out.schema  # resolved here
        return out
    except AnalysisException:
        return saved(df, "rows").select("*", place)


def word_count(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_order(df: DataFrame, *cols: str) -> DataFrame:
    """Add ``h``, a hexadecimal digest of ``cols`` that shuffles the rows the
    same way at every run, and ``cell``, its first three digits: 4,096 equal
    shares of the rows of any group, however large that group is."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return df.withColumn("h", F.md5(text)).withColumn("cell", F.substring("h", 1, 3))


def running_before(df: DataFrame, group: list[str], cell: str, order: list[str], value: Column,
                   name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that
    come earlier by (``cell``, ``order``). Sums per (group, cell) are
    pre-aggregated; only their few rows are windowed per group, so a group
    with a third of all rows is spread over its cells. Group and cell columns
    hold no nulls; ``cell`` grows with the order."""
    df = df.withColumn("__v", value)
    per_cell = df.groupBy(*group, cell).agg(F.sum("__v").alias("__s"))
    base = per_cell.withColumn(
        "__base", F.coalesce(F.sum("__s").over(
            W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("__v").over(
        W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (df.withColumn("__w", within)
            .join(base.drop("__s"), [*group, cell])
            .withColumn(name, (F.col("__base") + F.col("__w")).cast("long"))
            .drop("__v", "__w", "__base"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary Arrow column, and the int64 offsets of its
    rows in them (no copy). Nulls must have been replaced before."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    n = len(col)
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batches, rows: int = 2000, size: int = 2 << 20, col: int = 0):
    """Cut Arrow batches so that a part holds at most ``rows`` rows and about
    ``size`` bytes of column ``col`` (one row at least): bounds the working
    memory of vectorised code, whatever the lengths of the texts."""
    for b in batches:
        start, n = 0, b.num_rows
        if not n:
            continue
        _, offs = utf8(b.column(col))
        while start < n:
            end = int(np.searchsorted(offs, offs[start] + size, side="right")) - 1
            end = min(max(end, start + 1), start + rows, n)
            yield b.slice(start, end - start)
            start = end
