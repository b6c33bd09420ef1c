"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents are sets of word shingles (sorted 64-bit hashes). Sets that are
equal collapse to one representative first. A tile holds sets that may link:

* *Size bands.* Sizes are cut into bands (each half as large again as the one
  before). With Jaccard >= t the sizes of a pair differ by a factor of at most
  1/t, so a set belongs to its own band and, as the larger partner, to the
  bands below that it can reach.
* *Tiles.* A tile is one key. At high thresholds keys are contents of hash ranges:
  linked sets of a band differ in at most K elements, hash space is cut into
  K + 1 + T ranges, and of a linked pair at least T + 1 ranges hold the very same
  elements. (Keys of one element or none are left out if a set has at most T of
  them; a partner that has more keeps all of its own.) Where ranges would be short
  (``wide_ranges``), they are single elements instead. All elements have one
  order; two linked sets of n elements and more share at least t * n, so the
  first shared element is among the first n - ceil(t * n) + 1 of either: those are
  a set's keys, by band. Any order is right; this one puts elements that many
  documents share (passages, found on ``SAMPLE`` distinct documents) last, where
  few sets reach them, and orders the others by hash.

Pairs of a tile pass the bitmap bound: every bit set in one signature only
stands for an element of one set only, so bit counts bound the overlap from
above. What is left is decided by exact intersection of the sorted arrays,
built again from the whole texts.

No tile emits all its pairs. Round 1 pairs the three smallest ids of a tile
with its other members: all pairs of tiles of up to four. Larger tiles come
again if they hold several components (of tiles with the same members, one):
their bitmaps are compared block by block, and a spanning forest of the pairs
that pass between components is emitted. A tile whose forest the exact test
confirms is done. The others do the same with bitmaps four times as wide, which
let few pairs pass that do not link; where even then a pair is refused, every
pair between components that the wide bound lets pass is tested. So any two
documents that link end in one component.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import dropped, saved, slices, utf8
from basketry.llm.components import components
from basketry.llm.shingles import mix64, shingle_sets

HUBS = 3
BLOCK = 1024   # rows of one side of a block of a large tile
PART = 1 << 20  # bytes of text handled at once
NARROW, WIDE = 2, 8  # bits an element of a signature: of all sets, of those that are left
SAMPLE = 8192   # distinct documents (about) in which common elements are looked for
COMMON = 1 << 17  # common elements that come last


# -- bands and keys ---------------------------------------------------------

def _bands() -> list[tuple[int, int]]:
    """(lowest size, highest size) of every band."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, lo * 3 // 2) - 1
        out.append((lo, hi))
        lo = hi + 1
    return out


BANDS = _bands()


def prefix(s: np.ndarray, num: int, den: int, common: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The first elements of a set, of which any linked set shares one. ``common``:
    elements (sorted) that come late, and how late."""
    p = len(s) + num * len(s) // -den + 1
    if common is None or not len(common[0]):
        return s[:p]
    at = np.searchsorted(common[0], s)
    at[at == len(common[0])] = 0
    late = np.where(common[0][at] == s, common[1][at], 0)
    return s[np.lexsort((s, late))[:p]] if late.any() else s[:p]


def _ranged(num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(lowest size, highest size, ranges, T) of every band, for ``range_keys``."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, lo * 3 // 2) - 1
        k = (den - num) * (hi + hi * den // num) // (den + num)
        mean = lo / (k + 1)
        spare = math.ceil(0.05 * (k + 1)) if math.exp(-mean) * (1 + mean) < 0.03 else 0
        out.append((lo, hi, k + 1 + spare, spare))
        lo = hi + 1
    return out


_cache: dict = {}


def _edges(parts: int) -> np.ndarray:
    if parts not in _cache:
        _cache[parts] = np.array([(j * 2 ** 64) // parts for j in range(1, parts)], np.uint64)
    return _cache[parts]


def range_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys by content of hash ranges: two sets with Jaccard >= num/den that differ
    share one."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(s + np.uint64(0x51ED270B)), out=total[1:])
    keys = []
    if (num, den) not in _cache:
        _cache[num, den] = _ranged(num, den)
    bands = _cache[num, den]
    own = bisect_right(bands, (n, math.inf)) - 1
    for j in range(own, -1, -1):
        lo, hi, parts, spare = bands[j]
        if hi * den // num < n:
            break
        if parts == 1:  # stands for equal sets only, which have collapsed already
            continue
        at = np.empty(parts + 1, np.int64)
        at[0], at[-1] = 0, n
        at[1:-1] = np.searchsorted(s, _edges(parts))
        count = np.diff(at)
        content = total[at[1:]] - total[at[:-1]]
        tag = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
        key = mix64(content + mix64(tag + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        few = count < 2
        keys.append(key[~few] if few.sum() <= spare else key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def wide_ranges(num: int, den: int) -> bool:
    """Whether ranges hold six elements and more on average (9 at 0.9, 4 at 0.8):
    hardly any is then as short as one shingle."""
    return num >= 6 * (den - num)


def tile_keys(s: np.ndarray, num: int, den: int, common=None) -> np.ndarray:
    """Keys of one set: two sets with Jaccard >= num/den share one."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    if wide_ranges(num, den):
        return range_keys(s, num, den)
    first, keys = prefix(s, num, den, common), []
    for j in range(bisect_right(BANDS, (n, math.inf)) - 1, -1, -1):
        if BANDS[j][1] * den // num < n:
            break
        keys.append(mix64(first + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)))
    return np.concatenate(keys)


def bitmap(s: np.ndarray, room: int = NARROW) -> np.ndarray:
    """Signature of at least ``room`` bits an element, a power of two wide."""
    bits = 64
    while bits < room * len(s):
        bits *= 2
    at = np.zeros(bits, np.uint8)
    at[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(at, bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) folded to a smaller power of two."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def may_link(na, a, nb, b, num: int, den: int):
    """Whether the overlap bound of signatures (of one width) allows a link."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    over = np.minimum(na - only_a, nb - only_b)
    return den * over >= num * (na + nb - over)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Exact test on sorted arrays."""
    nx, ny = len(x), len(y)
    if not nx or not ny or den * min(nx, ny) < num * max(nx, ny):
        return False
    pos = np.searchsorted(y, x)
    pos[pos == ny] = ny - 1
    both = int((y[pos] == x).sum())
    return den * both >= num * (nx + ny - both)


# -- passes over the texts --------------------------------------------------

def _signatures(k: int):
    def run(batches):
        for part in slices(batches, size=PART):
            sets = shingle_sets(*utf8(part.column(0)), k)
            yield pa.RecordBatch.from_arrays([
                part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                *[pa.array([bitmap(s, room).tobytes() for s in sets], pa.binary()) for room in (NARROW, WIDE)]],
                ["doc_id", "n", "fp", "bits", "wide"])
    return run


def _elements(k: int):
    def run(batches):
        for part in slices(batches, size=PART):
            for s in shingle_sets(*utf8(part.column(0)), k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])
    return run


def _common(texts: DataFrame, reps: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that several of about ``SAMPLE`` documents hold, at most ``COMMON``
    of them, the most frequent first. Only the order of the elements depends on
    them, never a result."""
    step = max(1, reps.count() // SAMPLE)
    drawn = reps.where(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).select(F.col("rep").alias("doc_id"))
    held = texts.join(F.broadcast(drawn), "doc_id", "left_semi").select("text").mapInArrow(_elements(k), "s long")
    rows = held.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2").orderBy(F.col("c").desc(), "s").limit(COMMON).toArrow()
    s, c = rows.column("s").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    o = np.argsort(s)
    return s[o], np.frexp(c[o])[1].astype(np.int8)


def _keys(k: int, num: int, den: int, common):
    def run(batches):
        for part in slices(batches, size=PART):
            sets = shingle_sets(*utf8(part.column(0)), k)
            keys = [tile_keys(s, num, den, common) for s in sets]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["doc_id", "fp", "keys"])
    return run


# -- tiles ------------------------------------------------------------------

def _first_round(batches):
    """Rows (key, rep) sorted by both. Emits pairs (key null) with the smallest
    ids of a tile, and the members of tiles of more than HUBS + 1 rows."""
    now, members, count = None, [], 0
    out: list[list] = [[], [], []]

    def emit(key, x, y):
        out[0].append(key)
        out[1].append(x)
        out[2].append(y)

    def flush():
        res = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "x", "y"])
        for c in out:
            c.clear()
        return res

    for b in batches:
        key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
        # Rows whose neighbours have other keys are tiles of one.
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        if len(key):
            alone[0] = alone[-1] = False
        keep = np.flatnonzero(~alone)
        for kk, rr in zip(key[keep].tolist(), rep[keep].tolist()):
            if kk != now:
                now, members, count, last = kk, [], 0, None
            elif rr == last:
                continue
            last = rr
            count += 1
            for hub in members[:HUBS]:
                emit(None, hub, rr)
            if count <= HUBS + 1:
                members.append(rr)
            if count == HUBS + 2:
                for m in members:
                    emit(kk, m, m)
            if count >= HUBS + 2:
                emit(kk, rr, rr)
        if len(out[0]) > 100_000:
            yield flush()
    yield flush()


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _tile_pairs(side, rep, comp, n, bits, num, den, forest):
    """Pairs of one block across components that the bound lets pass, or a
    spanning forest of them. Rows are sorted by ``rep``."""
    sig = [np.frombuffer(x, np.uint64) for x in bits]
    width = np.array([len(x) for x in sig])
    low = int(width.min())
    base = np.stack([fold(x, low) for x in sig])
    root, parent = comp.copy(), {}
    for start in range(0, len(rep), 64):
        if forest and (root == root[0]).all():
            return
        here = slice(start, start + 64)
        few, many = np.minimum(n[here, None], n), np.maximum(n[here, None], n)
        ok = (rep[here, None] < rep) & (root[here, None] != root) & (den * few >= num * many)
        if side is not None:
            ok &= side[here, None] != side
        left, right = np.nonzero(ok)
        for cut in range(0, len(left), 1 << 14):
            i, j = left[cut:cut + (1 << 14)] + start, right[cut:cut + (1 << 14)]
            passed = may_link(n[i], base[i], n[j], base[j], num, den)
            i, j = i[passed], j[passed]
            both = np.minimum(width[i], width[j])
            for w in np.unique(both[both > low]).tolist():
                at = np.flatnonzero(both == w)
                wide = may_link(n[i[at]], np.stack([fold(sig[x], w) for x in i[at]]),
                                n[j[at]], np.stack([fold(sig[x], w) for x in j[at]]), num, den)
                both[at[~wide]] = 0
            i, j = i[both > 0], j[both > 0]
            for x, y in zip(i.tolist(), j.tolist()):
                if forest:
                    a, b = _find(parent, int(comp[x])), _find(parent, int(comp[y]))
                    if a == b:
                        continue
                    parent[a] = b
                yield int(rep[x]), int(rep[y])
        if forest and parent:
            root = np.array([_find(parent, c) for c in comp.tolist()])


def _later_rounds(num: int, den: int, forest: bool):
    cols = ["key", "ta", "tb", "block", "rep", "comp", "n", "bits"]

    def group(rows):
        key, a, b = (int(r[0]) for r in rows[:3])
        _, first = np.unique(rows[4], return_index=True)
        side, rep, comp, n = (np.asarray(r)[first] for r in rows[3:7])
        found = _tile_pairs(side if a != b else None, rep, comp, n, [rows[7][t] for t in first], num, den, forest)
        return ((key, x, y) for x, y in found)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(cols)
            if held is not None:
                t = pa.concat_tables([held, t])
            k = np.stack([t.column(i).to_numpy() for i in range(3)])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            done = int(cut[-1]) if len(cut) else 0
            held = t.slice(done)
            yield from batch(t.slice(0, done), cut.tolist())
        if held is not None:
            yield from batch(held, [held.num_rows])

    def batch(t, ends):
        pairs, start = [], 0
        rows = [t.column(i).to_pylist() if i == 7 else t.column(i).to_numpy() for i in range(8)]

        def made():
            p = np.array(pairs, np.int64)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[:, i]) for i in range(3)], ["key", "a", "b"])
        for end in ends:
            for pair in group([r[start:end] for r in rows]):
                pairs.append(pair)
                if len(pairs) >= 50_000:
                    yield made()
            start = end
        if pairs:
            yield made()
    return run


def _bound(num: int, den: int):
    """Rows (a, b, na, nb, bits_a, bits_b): the pairs that the bound lets pass."""
    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for x, y, p, q in zip(na, nb, b.column(4), b.column(5)):
                if den * min(x, y) < num * max(x, y):
                    keep.append(False)
                    continue
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                w = min(len(s), len(t))
                keep.append(bool(may_link(x, fold(s, w), y, fold(t, w), num, den)))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))
    return run


# -- exact test -------------------------------------------------------------

def _compare(k: int, num: int, den: int):
    """Rows (text, doc_id, hub, salt, member), hub texts first in a group."""
    def run(batches):
        now, hubs = None, []
        for part in slices(batches, size=PART):
            sets = shingle_sets(*utf8(part.column(0)), k)
            ids, hub, salt, member = (part.column(i).to_pylist() for i in range(1, 5))
            a, b, ok = [], [], []
            for i, s in enumerate(sets):
                if (hub[i], salt[i]) != now:
                    now, hubs = (hub[i], salt[i]), []
                if not member[i]:
                    hubs.append(s)
                    continue
                a.append(hub[i])
                b.append(ids[i])
                ok.append(any(linked(h, s, num, den) for h in hubs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
    return run


def _verified(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``a, b, ok`` of candidate pairs, decided on the whole texts. The pairs of
    one hub are dealt to several tasks, 128 at a time, each with the hub's text."""
    spark = texts.sparkSession
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 128)).alias("salt"))
    want = salted.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "salt", F.lit(1).alias("member")).unionByName(
        salted.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), "salt", F.lit(0).alias("member")).distinct())
    want = saved(want, "want")
    rows = texts.join(want, "doc_id").select("text", "doc_id", "hub", "salt", "member")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    checked = rows.mapInArrow(_compare(k, num, den), "a long, b long, ok boolean")
    return saved(checked.groupBy("a", "b").agg(F.max("ok").alias("ok")), "verified")


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents link when ``den * |intersection| >= num * |union|`` of their sets
    of ``k``-word shingles (A-Z lower-cased; words are runs of other than ASCII
    white space; fewer than ``k`` words count as one shingle). ``component_id``
    is the smallest id reachable by links. Null and empty texts have no
    shingles and link with nothing. Rows of one id are one node: they share
    their links. A null id links with nothing and has no component. Other
    columns play no part. No rows: empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    sets = saved(texts.mapInArrow(_signatures(k), "doc_id long, n long, fp binary, bits binary, wide binary"), "sets")
    nodes = sets.where("n > 0 and doc_id is not null")
    reps = saved(nodes.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                         F.first("bits").alias("bits")), "reps")
    members = saved(sets.select("doc_id", "n", "fp").join(reps.select("fp", "rep"), "fp", "left")
                    .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "members")

    common = None if wide_ranges(num, den) else _common(texts, reps, k)
    keys = texts.mapInArrow(_keys(k, num, den, common), "doc_id long, fp binary, keys array<long>")
    keys = keys.join(reps.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"]).select(
        F.explode("keys").alias("key"), F.col("doc_id").alias("rep"))
    tiles = keys.repartition(parts, "key").sortWithinPartitions("key", "rep")
    first = saved(tiles.mapInArrow(_first_round, "key long, x long, y long"), "tiles")
    pairs = saved(first.where("key is null").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    large = first.where("key is not null").select("key", F.col("x").alias("rep"))

    def side(s):
        return reps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}"))
    passed = saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
                   .mapInArrow(_bound(num, den), "a long, b long").distinct(), "passed")
    found = _verified(texts, passed, k, num, den).where("ok").select("a", "b")
    # An id whose rows have different sets ties those sets together.
    ties = members.where("rep is not null").select("doc_id", "rep").distinct()
    low = ties.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("z")).where("m < z")
    links = found.unionByName(ties.join(low, "doc_id").where("rep <> m").select(F.col("m").alias("a"), F.col("rep").alias("b")))
    comp = saved(components(links), "components")

    signed, widened = reps.select("rep", "n", "bits"), False
    for last in (False, False, True):
        left = large.join(comp, large["rep"] == comp["id"], "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("comp"))
        many = left.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"),
            *[F.sum(F.xxhash64(F.lit(i), "rep").cast("decimal(38,0)")).alias(f"m{i}") for i in range(2)]).where("lo < hi")
        # Tiles of the very same members have the same pairs: one of them will do.
        many = many.groupBy("c", "m0", "m1").agg(F.min("key").alias("key"))
        left = left.join(many.select("key", F.ceil(F.col("c") / BLOCK).alias("g")), "key").withColumn(
            "block", F.pmod(F.xxhash64("rep"), F.col("g"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        left = left.join(signed, "rep").select(
            "key", F.least("block", "t").alias("ta"), F.greatest("block", "t").alias("tb"), "block", "rep", "comp", "n", "bits")
        again = left.repartition(parts, "key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "rep")
        again = saved(again.mapInArrow(_later_rounds(num, den, not last), "key long, a long, b long"), "passed")
        if again.isEmpty():
            break
        checked = _verified(texts, again.select("a", "b").distinct(), k, num, den)
        links = links.unionByName(checked.where("ok").select("a", "b"))
        comp = saved(components(links), "components")
        if last:
            break
        refused = saved(again.join(checked.where("not ok"), ["a", "b"], "left_semi").select("key").distinct(), "refused")
        if refused.isEmpty():
            break
        large = saved(large.join(refused, "key", "left_semi"), "tiles")
        if not widened:
            widened = True
            left = large.select("rep").distinct().join(reps.select("rep", "fp"), "rep")
            signed = saved(sets.select(F.col("doc_id").alias("rep"), "fp", "n", F.col("wide").alias("bits"))
                           .join(left, ["rep", "fp"], "left_semi").drop("fp"), "wide")
    out = members.join(comp, members["rep"] == comp["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs`` that stay: of every component the row with the smallest
    ``doc_id`` (repeated rows of that id all stay; a null id stays)."""
    comp = ngram_components(docs, k, num, den)
    gone = saved(comp.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
