"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned (ITQ) so that the signs of the
rotated coordinates form balanced binary codes. Substrings of the codes are
the keys of several tables; vectors of one label that agree on a substring
meet there and are reranked by the cosine of the original vectors in double
precision. Everything is fitted on a bounded sample; every vector is indexed.

* Equal vectors of one label collapse first; links count their copies.
* Substrings have about log2(n) bits (n: most distinct vectors of a label), so
  a bucket holds a few rows by chance. The number of tables follows from the
  chance that two vectors at exactly the threshold agree on one substring, for
  an expected recall of ``RECALL``; further rotations supply further tables.
* A bucket of more than ``BLOCK`` rows is dealt to tiles of two blocks each,
  so no task holds more than two blocks, and no rows are left out.
* A tile emits a row per linked vector: the links it adds, and the smallest id
  of its component there. Pairs themselves are never emitted. A pair that meets
  in several tables counts in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import saved
from basketry.llm.components import components

SAMPLE = 4096   # vectors that the rotations are fitted on
BITS = 64       # of a code, at most
BLOCK = 1024
RECALL = 0.99


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn(sample: np.ndarray, rotations: int, bits: int = BITS, steps: int = 40):
    """Mean and projections (one per rotation) to coordinates whose signs are
    the code bits."""
    mean = sample.mean(0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :min(bits, sample.shape[1])]
    v = x @ axes
    out = []
    for seed in range(rotations):
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, out


def _fit_width(x: np.ndarray, width: int) -> np.ndarray:
    """Vectors padded with zeros or cut to the width the codes were learned on
    (codes only retrieve; the rerank sees the whole vectors)."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _table_keys(model, length: int):
    mean, projections = model
    per = max(1, projections[0].shape[1] // length)
    weights = (1 << np.arange(length, dtype=np.int64))

    def run(batches):
        for b in batches:
            lists, sizes = b.column(1), b.column(2).to_numpy()
            keys = np.zeros((b.num_rows, per * len(projections)), np.int64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                y = _fit_width(_unit(x), len(mean)) - mean
                for k, p in enumerate(projections):
                    bit = (y @ p) >= 0
                    for t in range(per):
                        part = bit[:, t * length:(t + 1) * length]
                        keys[at, k * per + t] = part @ weights[:part.shape[1]]
            offs = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(offs, pa.array(keys.ravel()))], ["rep", "keys"])
    return run


def _tile(t, side, rep, mult, keys, x, threshold):
    """Per row of a tile: links it adds, and its local component."""
    u = _unit(x)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    fresh = np.ones(len(i), bool)
    for earlier in range(t):
        fresh &= keys[i, earlier] != keys[j, earlier]
    links = np.bincount(i[fresh], weights=mult[j[fresh]], minlength=len(rep)).astype(np.int64)
    low = rep.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        if (new == low).all():
            break
        low = new
    hit = np.unique(i)
    return rep[hit], low[hit], links[hit]


def _rerank(threshold: float):
    """Rows (label, dim, t, key, ta, tb, block, rep, mult, keys, v) sorted by
    tile."""
    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            cols = [t.column(i) for i in range(6)]
            change = np.zeros(t.num_rows - 1, bool)
            for c in cols:
                c = c.combine_chunks()
                if pa.types.is_string(c.type):
                    c = c.dictionary_encode()
                    c = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices
                v = c.to_numpy(zero_copy_only=False)
                change |= v[1:] != v[:-1]
            cut = np.flatnonzero(change) + 1
            done = int(cut[-1]) if len(cut) else 0
            held = t.slice(done)
            yield from part(t.slice(0, done), cut)
        if held is not None:
            yield from part(held, np.array([held.num_rows]))

    def part(t, ends):
        if not t.num_rows:
            return
        dim, table, ta, tb, block, rep, mult = (t.column(i).to_numpy() for i in (1, 2, 4, 5, 6, 7, 8))
        lists, vectors = t.column(9).combine_chunks(), t.column(10).combine_chunks()
        out, start = [], 0
        for end in ends.tolist():
            if end - start > 1:
                k, v = lists.slice(start, end - start), vectors.slice(start, end - start)
                n = end - start
                side = block[start:end] if ta[start] != tb[start] else None
                got = _tile(int(table[start]), side, rep[start:end].astype(np.int64), mult[start:end],
                            k.flatten().to_numpy().reshape(n, -1),
                            v.flatten().to_numpy().astype(np.float64).reshape(n, int(dim[start])), threshold)
                if got is not None:
                    out.append(got)
            start = end
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "low", "links"])
    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths are
    equal, and their cosine is at least ``threshold``. A vector that is null,
    empty, zero, or holds a null or non-finite component links with nothing.
    ``component_id`` is the smallest id reachable by links (null ids count as
    largest), ``kept`` whether it is the row's own. Repeated rows are vectors
    of their own that link with each other. No rows: empty result. Other columns
    of ``vectors``, whatever their names, play no part.

    The number of tables follows from the wanted recall for vectors as spread as
    a sample of them; where it would pass some 4,600 (a chance of 1 in 1,000 to
    meet in one table, as for very many vectors close to one direction) it stays
    there, and the expected recall at exactly the threshold falls below ``RECALL``
    (to 0.97 in that example at 10^9 vectors).
    """
    spark = vectors.sparkSession
    v = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"),
                          F.col(f"`{label}`").cast("string").alias("label"), F.monotonically_increasing_id().alias("rid"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = saved(rows.withColumn("valid", valid), "vectors")
    good = rows.where("valid")
    reps = saved(good.groupBy("label", "v").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("mult"))
                 .withColumn("dim", F.size("v")), "reps")
    members = good.join(reps.select("label", "v", "rep", "mult"), ["label", "v"]).select("rid", "vec_id", "rep", "mult")

    most = reps.groupBy("label").count().agg(F.max("count").alias("n")).head()["n"]
    lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                       F.lit(True).alias("kept"))
    if not most:
        return lone
    some = [r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").select("v").limit(SAMPLE).collect()]
    width = max(map(len, some))
    sample = np.concatenate([_fit_width(_unit(np.array([x], np.float64)), width) for x in some])
    bits = min(BITS, width)
    length = min(bits, max(8, round(math.log2(most))))
    spread = float(np.sqrt(((sample - sample.mean(0)) ** 2).sum(1)).mean()) or 1.0
    agree = max(1e-3, (1 - min(0.9, math.acos(threshold) / (math.pi * spread))) ** length)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree, 0.999)))
    model = learn(sample, math.ceil(tables / max(1, bits // length)))

    coded = saved(reps.select("rep", "v", "dim").mapInArrow(_table_keys(model, length), "rep long, keys array<long>"), "codes")
    full = coded.join(reps, "rep")
    spot = ["label", "dim", "t", "key"]
    keyed = full.select("label", "dim", "rep", F.posexplode("keys").alias("t", "key"))
    shared = keyed.groupBy(*spot).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    dealt = keyed.join(shared, spot).withColumn("g", F.ceil(F.col("c") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("g"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tile = [*spot, "ta", "tb"]
    dealt = dealt.withColumn("ta", F.least("block", "o")).withColumn("tb", F.greatest("block", "o")).select(*tile, "block", "rep")
    met = dealt.join(full.select("rep", "mult", "keys", "v"), "rep").select(*tile, "block", "rep", "mult", "keys", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, *tile).sortWithinPartitions(*tile)
    hits = saved(met.mapInArrow(_rerank(threshold), "rep long, low long, links long"), "hits")

    links = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = saved(components(hits.select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()), "components")
    found = members.join(links, "rep", "left").join(comp, members["rep"] == comp["id"], "left").select(
        "rid", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("comp"))
    found = saved(found, "linked")
    low = found.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    out = found.join(low, "comp").select("vec_id", "n_links", "component_id",
                                         F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    rest = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)
