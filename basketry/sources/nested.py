"""The nested-column read test: a 30-field struct, its text form, Parquet.

Field types (struct ``a``): bigint a4 a14 a18 a24 a25 a28 a30; boolean a9;
array<string> a5 a17 a20 a22 (two items each); string otherwise. Text form:
fields separated by \\x02, array items by \\x03. The generator writes text
into a4, so a4 loads as NULL (Hive's bad-cast rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_SEP = "\x02"
ITEM_SEP = "\x03"

# Fixed layout of the reference's nested test table.
LONG_FIELDS = (4, 14, 18, 24, 25, 28, 30)
BOOL_FIELDS = (9,)
ARRAY_FIELDS = (5, 17, 20, 22)
N_FIELDS = 30


def field_type(i: int) -> T.DataType:
    if i in LONG_FIELDS:
        return T.LongType()
    if i in BOOL_FIELDS:
        return T.BooleanType()
    if i in ARRAY_FIELDS:
        return T.ArrayType(T.StringType())
    return T.StringType()


NESTED_STRUCT = T.StructType([T.StructField(f"a{i}", field_type(i)) for i in range(1, N_FIELDS + 1)])
NESTED_SCHEMA = T.StructType([T.StructField("a", NESTED_STRUCT)])


def _token(key: Column, seed: int, i: int, j: int = 0) -> Column:
    """20 hexadecimal characters derived from (key, seed, field, item)."""
    return F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed)),
                                          F.lit(str(i)), F.lit(str(j))), 256), 1, 20)


def gen_nested(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One nested row per input row (keyed by ``key``), repeatable for a seed.

    Strings are 20 hex characters of a SHA-256 of (key, seed, field); longs
    and booleans are arithmetic on the key; a4 holds text, as in the
    reference generator.
    """
    k = F.col(key).cast("long")
    fields = []
    for i in range(1, N_FIELDS + 1):
        if i == 4:
            v = _token(k, seed, i)          # text in a bigint field
        elif i in LONG_FIELDS:
            v = k * F.lit(i) + F.lit(seed)
        elif i in BOOL_FIELDS:
            v = F.pmod(k + F.lit(seed), F.lit(2)) == 0
        elif i in ARRAY_FIELDS:
            v = F.array(_token(k, seed, i, 1), _token(k, seed, i, 2))
        else:
            v = _token(k, seed, i)
        fields.append(v.alias(f"a{i}"))
    return df.select(F.struct(*fields).alias("a"))


def nested_to_text(df: DataFrame) -> DataFrame:
    """The \\x02/\\x03 text form of a nested frame: one ``value`` per row."""
    parts = []
    for i in range(1, N_FIELDS + 1):
        c = F.col(f"a.a{i}")
        if i in ARRAY_FIELDS:
            c = F.array_join(c, ITEM_SEP)
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return df.select(F.concat_ws(FIELD_SEP, *parts).alias("value"))


def load_nested_text(spark: SparkSession, path: str, field_sep: str = FIELD_SEP,
                     item_sep: str = ITEM_SEP) -> DataFrame:
    """Text with control-character delimiters -> one struct column ``a``.

    Numbers and booleans use ``try_cast`` (bad text -> NULL); arrays split on
    ``item_sep``; missing trailing fields are NULL.
    """
    raw = spark.read.text(path)
    parts = F.split(F.col("value"), field_sep, -1)
    fields = []
    for i in range(1, N_FIELDS + 1):
        s = F.get(parts, i - 1)
        t = field_type(i)
        if isinstance(t, T.ArrayType):
            v = F.split(s, item_sep, -1)
        elif isinstance(t, T.StringType):
            v = s
        else:
            v = s.try_cast(t)
        fields.append(v.alias(f"a{i}"))
    return raw.select(F.struct(*fields).alias("a"))


def nested_to_columnar(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def nested_project(df: DataFrame, leaves: list[int], limit: int | None = 100,
                   struct: str = "a") -> DataFrame:
    """Select some leaves of the struct; Parquet reads only those leaves
    (nested schema pruning shows them alone in ``ReadSchema``)."""
    out = df.select(*[F.col(f"{struct}.a{i}").alias(f"a{i}") for i in leaves])
    return out.limit(limit) if limit is not None else out
