"""Exact dedup by content-defined chunk recipes.

Each normalised text is cut where a hash of the last 16 bytes has ten zero
bits, so equal passages are cut equally wherever they stand. A chunk is known
by a 128-bit identifier; a document by its recipe, the ordered list of its
chunks' identifiers (16 bytes per kilobyte of text). Documents are equal when
their recipes are: only recipes are shuffled to group and join documents, never
their texts again.

Identifiers are verified: chunks are deduplicated by identifier *and* SHA-256 of
their content (partial aggregation first, so copies collapse before the
shuffle; the contents themselves never move). An identifier with two contents
is a clash; documents whose recipe holds one are compared by recipe and SHA-256 of
the text instead. All documents with equal recipes hold the same identifiers,
so a group is treated one way as a whole.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACES, saved, slices, utf8, with_row_id

MASK = np.uint32(1023)  # a cut every kilobyte on average
SMALLEST, LARGEST = 256, 8192
_GEAR = np.random.default_rng(20240501).integers(0, 2 ** 32, 256, dtype=np.uint32)
_MUL = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def normalised(text):
    """Column: null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def cut_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk bounds of all rows of a batch (they tile ``data``) and, per row,
    the index of its first chunk. Empty rows have no chunk."""
    h = _GEAR[data]
    for step, mul in zip((1, 2, 4, 8), _MUL):
        h[step:] = h[step:] * mul + h[:-step].copy()
    h ^= h >> np.uint32(15)
    at = (np.flatnonzero((h & MASK) == 0) + 1).tolist()
    bounds, first, k, last = [0], [0], 0, len(at)
    for start, end in zip(offs[:-1].tolist(), offs[1:].tolist()):
        pos = start
        while pos < end:
            limit = min(pos + LARGEST, end)
            while k < last and at[k] < pos + SMALLEST:
                k += 1
            pos = at[k] if k < last and at[k] < limit else limit
            bounds.append(pos)
        first.append(len(bounds) - 1)
    return np.array(bounds, np.int64), np.array(first, np.int64)


def _chunks(data: np.ndarray, offs: np.ndarray, id_bytes: int):
    bounds, first = cut_points(data, offs)
    raw = memoryview(np.ascontiguousarray(data))
    b = bounds.tolist()
    ids = [xxhash.xxh3_128_digest(raw[s:e])[:id_bytes] for s, e in zip(b, b[1:])]
    return bounds, first.tolist(), ids


def _recipes(id_bytes: int):
    def run(batches):
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            _, first, ids = _chunks(data, offs, id_bytes)
            recipe = [b"".join(ids[a:z]) for a, z in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(recipe, pa.binary())], [*part.schema.names[1:], "recipe"])
    return run


def _contents(id_bytes: int):
    def run(batches):
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            bounds, _, ids = _chunks(data, offs, id_bytes)
            raw, b = memoryview(np.ascontiguousarray(data)), bounds.tolist()
            content = pa.array([sha256(raw[x:y]).digest() for x, y in zip(b, b[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), content], ["chunk_id", "content"])
    return run


def clashing_ids(docs: DataFrame, text: str = "text", id_bytes: int = 16) -> DataFrame:
    """Identifiers that stand for more than one chunk content (none, but for
    chance): the check of the chunk store, on SHA-256 of the contents."""
    chunks = docs.select(normalised(F.col(text)).alias("norm")).mapInArrow(
        _contents(id_bytes), "chunk_id binary, content binary")
    distinct = chunks.groupBy("chunk_id", "content").agg(F.count(F.lit(1)).alias("n"))
    return (distinct.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_contents"))
            .where("n_contents > 1").select("chunk_id"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", id_bytes: int = 16,
                keep: tuple[str, ...] = (), row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``, and the columns named in ``keep``.

    Texts are equal when identical after every run of ASCII white space became
    one space; null counts as empty (empty texts are equal to each other).
    The row with the smallest ``doc_id`` stays; a null id is larger than any
    other. Of rows repeated with the same id and text exactly one is kept, all
    are counted. Other columns of ``docs``, whatever their names, play no part.
    ``row_id`` names a column that identifies the rows (else made here).
    """
    out_cols = [doc_id, *keep]
    rows = docs.select(normalised(F.col(f"`{text}`")).alias("__norm"),
                       F.sha2(normalised(F.col(f"`{text}`")), 256).alias("__sha"),
                       (F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()).alias("__rid"),
                       *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(out_cols)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    recipes = saved(rows.mapInArrow(_recipes(id_bytes), f"{schema}, recipe binary"), "recipes")

    clash = saved(clashing_ids(docs.select(F.col(f"`{text}`").alias("text")), id_bytes=id_bytes), "clash")
    if clash.isEmpty():
        keyed = recipes.withColumn("__key", F.col("recipe"))
    else:
        ids = recipes.where(F.length("recipe") > 0).select("__rid", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("recipe"), F.lit(id_bytes)),
            lambda i: F.substring(F.col("recipe"), i, F.lit(id_bytes)))).alias("chunk_id"))
        flagged = ids.join(clash, "chunk_id", "left_semi").select("__rid").distinct()
        keyed = recipes.join(flagged.withColumn("__flag", F.lit(True)), "__rid", "left").withColumn(
            "__key", F.when(F.col("__flag"), F.concat("recipe", F.unhex("__sha"))).otherwise(F.col("recipe")))
    order = F.struct(F.col("__c0").isNull().alias("isnull"), F.col("__c0").alias("id"), F.col("__rid").alias("rid"))
    groups = keyed.groupBy("__key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    joined = keyed.join(groups, "__key")
    return joined.select(
        F.col("__c0").alias(doc_id), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("__rid") == F.col("first.rid")).alias("kept"), F.col("__sha").alias("text_sha256"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(out_cols) if i])


def one_of_equal(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts the one that ``exact_dedup`` keeps.
    Only ids decide; the texts meet the lost rows' ids once."""
    numbered = with_row_id(docs, "__row")
    lost = exact_dedup(numbered, keep=("__row",), row_id="__row").where("not kept").select("__row")
    return numbered.join(saved(lost, "lost"), "__row", "left_anti").select(*docs.columns)
