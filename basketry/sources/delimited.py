"""Delimited text in and out, appends, multi-target writes, materialised steps.

Text loads follow the reference's Hive semantics: every field is read as a
string and cast with ``try_cast`` to the declared type, so a bad number or
an empty non-string field becomes NULL instead of failing the job; ``\\N``
marks NULL, an empty string field stays ''. Too few fields give NULLs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import scratch_path

HIVE_NULL = "\\N"


def load_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    """Read ``sep``-separated text with a declared schema (no inference).

    Lines are split on the literal separator (no quoting, as in Hive text
    tables); every line is kept.
    """
    parts = F.split(F.col("value"), "\\Q" + sep + "\\E", -1)
    cols = []
    for i, f in enumerate(schema.fields):
        raw = F.get(parts, i)
        v = F.when(raw != F.lit(HIVE_NULL), raw)
        cols.append(v.alias(f.name) if isinstance(f.dataType, T.StringType)
                    else v.try_cast(f.dataType).alias(f.name))
    return spark.read.text(path).select(*cols)


def load_checked(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    """``load_delimited`` with a record of what it could not take, in the same pass:
    ``_line`` (the line as it stands, where anything is wrong, else null) and
    ``_rejects``, an array of (column, reason, value). Reasons: ``type`` (the
    field is no value of the declared type and becomes NULL), ``missing`` (the
    line ends before the field), ``surplus`` (fields after the last column; the
    column is null). Write it once; ``rejected_fields`` lists the rejects."""
    parts = F.split(F.col("value"), "\\Q" + sep + "\\E", -1)
    rows = spark.read.text(path).select("value", parts.alias("_parts"))
    cols, faults = [], []
    fault = "struct<column:string,reason:string,value:string>"
    for i, f in enumerate(schema.fields):
        raw = F.get("_parts", F.lit(i))
        v = F.when(raw != F.lit(HIVE_NULL), raw)
        typed = v if isinstance(f.dataType, T.StringType) else v.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
        bad = F.when(F.size("_parts") <= i, "missing")
        if not isinstance(f.dataType, T.StringType):
            bad = bad.when(typed.isNull() & v.isNotNull() & (v != ""), "type")
        faults.append(F.when(bad.isNotNull(), F.struct(F.lit(f.name).alias("column"), bad.alias("reason"), v.alias("value")).cast(fault)))
    n = len(schema.fields)
    surplus = F.array_join(F.slice("_parts", n + 1, F.greatest(F.size("_parts") - n, F.lit(0))), sep)
    faults.append(F.when(F.size("_parts") > n, F.struct(
        F.lit(None).cast("string").alias("column"), F.lit("surplus").alias("reason"), surplus.alias("value")).cast(fault)))
    out = rows.select(*cols, F.filter(F.array(*faults), lambda x: x.isNotNull()).alias("_rejects"), "value")
    return out.select(*schema.fieldNames(), F.when(F.size("_rejects") > 0, F.col("value")).alias("_line"), "_rejects")


def rejected_fields(loaded: DataFrame) -> DataFrame:
    """(column, reason, value, line): the rejects of a checked load."""
    return loaded.where(F.col("_line").isNotNull()).select(F.explode("_rejects").alias("_r"), F.col("_line").alias("line")).select(
        "_r.column", "_r.reason", "_r.value", "line")


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = False) -> str:
    """Write ``df`` as ``sep``-separated text (NULL as \\N), overwriting ``path``."""
    (df.write.mode("overwrite").option("sep", sep).option("header", header)
       .option("nullValue", HIVE_NULL).option("emptyValue", "").option("quote", "\u0000")
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path))
    return path


def to_columnar(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Create-table-as-select into a columnar format (parquet/orc)."""
    df.write.mode(mode).format(fmt).save(path)
    return path


def sink_result_text(df: DataFrame, path: str, sep: str = ",") -> str:
    """Result as comma text in a directory of its own (overwritten)."""
    df.write.mode("overwrite").option("sep", sep).option("nullValue", HIVE_NULL).csv(path)
    return path


def append_refresh(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base rows followed by a refresh set with the same columns (append-only)."""
    return base.unionByName(delta)


def append_refresh_table(base: DataFrame, delta: DataFrame, path: str,
                         fmt: str = "parquet") -> str:
    """Load ``base`` into a table at ``path``, then append ``delta`` to it."""
    base.write.mode("overwrite").format(fmt).save(path)
    delta.write.mode("append").format(fmt).save(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def stage_refresh(delta: DataFrame, table: str, fmt: str = "parquet") -> str:
    """Write a refresh set beside the table's data; readers do not see it."""
    staged = f"{table}/_staged/{uuid.uuid4().hex}"
    delta.write.format(fmt).save(staged)
    return staged


def publish_refresh(spark: SparkSession, table: str, refresh_id: str, staged: str) -> bool:
    """Make a staged set part of the table, as a whole and once: its folder is
    renamed to that of the refresh id (atomic on file systems with an atomic
    rename; one writer at a time). False if that refresh is in the table
    already; the staged set is then deleted."""
    fs, path = _hadoop(spark, table)
    target = path(f"{table}/data/refresh={refresh_id}")
    if fs.exists(target):
        fs.delete(path(staged), True)
        return False
    fs.mkdirs(target.getParent())
    if not fs.rename(path(staged), target):
        raise OSError(f"could not publish refresh {refresh_id} of {table}")
    return True


def refresh_table(delta: DataFrame, table: str, refresh_id: str, fmt: str = "parquet") -> bool:
    """Append a refresh set to a table: staged, then published. May be repeated
    after any failure: a set counts once, under its ``refresh_id`` (letters,
    digits, ``-`` and ``_``), and not at all until it is complete."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", refresh_id):
        raise ValueError(f"refresh id {refresh_id!r}")
    spark = delta.sparkSession
    fs, path = _hadoop(spark, table)
    if fs.exists(path(f"{table}/data/refresh={refresh_id}")):
        return False
    return publish_refresh(spark, table, refresh_id, stage_refresh(delta, table, fmt))


def read_refreshed(spark: SparkSession, table: str, fmt: str = "parquet") -> DataFrame:
    """All published sets of a table, with their ``refresh`` id as a column."""
    return spark.read.option("basePath", f"{table}/data").format(fmt).load(f"{table}/data")


def multi_insert(df: DataFrame, targets: dict[str, Column], column: str = "target") -> DataFrame:
    """One pass over ``df`` feeding several filtered targets: a row is
    emitted once per target whose predicate it satisfies, tagged in
    ``column`` (write it with ``partitionBy(column)`` to get one folder per
    target)."""
    tags = F.array(*[F.when(p, F.lit(name)) for name, p in targets.items()])
    return (df.withColumn(column, F.explode(F.filter(tags, lambda t: t.isNotNull()))))


def ctas_temp(spark: SparkSession, df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Materialise a step as a table in the shared checkpoint folder and
    read it back: later steps (and retries after a lost executor) start from
    the written table instead of recomputing the lineage."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
