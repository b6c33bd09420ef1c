"""Packing by optimal length buckets.

The global histogram of lengths (one row per distinct length) goes to the
driver. Its size has a proven bound: distinct lengths add up to at most the
number of tokens T, so there are fewer than sqrt(2 T) + 1 of them. Dynamic
programming over the histogram picks the ``buckets`` upper bounds that minimise
the padding of all documents; the best split point never moves left as the
prefix grows, so each layer is solved by divide and conquer, level by level.
Within a bucket, documents in hash order fill batches of as many rows as the
token budget holds when each is padded to the bucket's bound. Row numbers
within a bucket come from ``running_before``, so a bucket with a third of all
rows is spread over its cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import hash_order, running_before, saved, word_count


def _layer(prev: np.ndarray, lengths: np.ndarray, cnt: np.ndarray, tok: np.ndarray):
    """Best cost of covering the first j lengths with one bucket more, and the
    split of each j. cost(i, j) = L[j-1] * (cnt[j] - cnt[i]) - (tok[j] - tok[i])."""
    d = len(lengths)
    best, split = np.full(d + 1, np.inf), np.zeros(d + 1, np.int64)
    best[0] = 0.0
    todo = [(1, d, 0, d - 1)]
    while todo:
        lo, hi, a, z = todo.pop()
        if lo > hi:
            continue
        j = (lo + hi) // 2
        i = np.arange(a, min(z, j - 1) + 1)
        cost = prev[i] + lengths[j - 1] * (cnt[j] - cnt[i]) - (tok[j] - tok[i])
        k = int(np.argmin(cost))
        best[j], split[j] = cost[k], i[k]
        todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), z)]
    return best, split


def optimal_bounds(lengths, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total
    padding (``lengths`` distinct and ascending)."""
    lengths = np.asarray(lengths, np.float64)
    d = len(lengths)
    if not d:
        return []
    counts = np.asarray(counts, np.float64)
    cnt = np.concatenate([[0.0], np.cumsum(counts)])
    tok = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0.0], lengths * cnt[1:] - tok[1:]])
    splits = [np.zeros(d + 1, np.int64)]
    for _ in range(min(buckets, d) - 1):
        best, split = _layer(best, lengths, cnt, tok)
        splits.append(split)
    bounds, j = [], d
    for split in reversed(splits):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(split[j])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384, length: Column | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, bucket`` (from 0),
    ``bucket_len`` (its bound), ``batch`` (within the bucket), ``slot`` (within
    the batch), ``padding`` (bound less length).

    A batch holds ``budget div bucket_len`` rows; a bucket longer than the
    budget has batches of one row. ``length`` is the tokens of a row (default:
    its words). Null and empty texts have length 0 and still get a place.
    Repeated rows count each. No rows: empty result. Other
    columns of ``docs``, whatever their names, play no part.
    """
    n = word_count(F.col(f"`{text}`")) if length is None else length
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), n.cast("long").alias("n_tokens"),
                       F.monotonically_increasing_id().alias("rid"))
    rows = saved(hash_order(rows, "doc_id", "n_tokens"), "lengths")
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_tokens")
    bounds = optimal_bounds(hist["n_tokens"].to_numpy(), hist["n"].to_numpy(), buckets) or [0]
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(arr, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn(
        "bucket_len", F.element_at(arr, F.col("bucket") + 1)).withColumn(
        "per", F.greatest(F.expr(f"{int(budget)} div greatest(bucket_len, 1)"), F.lit(1)))
    rows = running_before(rows, ["bucket"], "cell", ["h", "doc_id", "rid"], F.lit(1), "pos")
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_len",
                       F.expr("pos div per").alias("batch"), (F.col("pos") % F.col("per")).alias("slot"),
                       (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
