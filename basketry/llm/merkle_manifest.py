"""Merkle manifest of a dataset: leaf coordinates by bitmap rank, trees from slots.

Every group (language) keeps its ids as a compressed bitmap: only the words of
64 ids that hold one, made by a map-side combined bit-or. Popcount directories
above them (words in a container of 512, then ``FAN_BITS`` bits a level) say how
many ids lie before each word, so the place of a leaf in its tree is a look-up
and a popcount: the leaves are never sorted, and no directory node has more
than 2**FAN_BITS children.

With places known, ``BLOCK`` consecutive leaves meet as one row, an array keyed
by slot. A block reduces four levels of the tree in its task, its top is a leaf
of the next round, and a group of n leaves takes log(n) / log(BLOCK) rounds. On
the way down each block gets the siblings above it, so that every leaf's proof
is read off its own block.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketry.llm.common import running_before, saved

FAN = 8                 # children of a node
DEPTH = 4               # levels that one block reduces
BLOCK = FAN ** DEPTH    # nodes of a block
FAN_BITS = 13           # bits of an id that one directory level resolves
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_part(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``g`` (group), ``doc_id``, ``leaf`` and ``shown``: the digest of the row as
    it is shown, which is the tampered one for every third crc32 of the id."""
    d, s, l, n, t = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.coalesce(F.crc32(d.cast("string")) % 3 == 0, F.lit(False)) & t.rlike("[A-Z]")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), l), F.lit("-")).alias("g"), d.cast("long").alias("doc_id"),
        leaf_digest(d, s, l, n, t).alias("leaf"),
        F.when(tampered, leaf_digest(d, s, l, n, F.translate(t, UPPER, LOWER))).alias("shown"))
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


def _before(counts: DataFrame, node: str, bits: int) -> DataFrame:
    """Popcount directory: ``counts`` (g, node, n) with ``base``, the ids of the
    group before the node. A window spans the children of one parent."""
    if bits <= FAN_BITS:
        w = W.partitionBy("g").orderBy(node).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    up = node + "u"
    counts = counts.withColumn(up, F.shiftright(node, FAN_BITS))
    above = _before(counts.groupBy("g", up).agg(F.sum("n").alias("n")), up, bits - FAN_BITS)
    w = W.partitionBy("g", up).orderBy(node).rowsBetween(W.unboundedPreceding, -1)
    within = counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    above = above.select("g", up, F.col("base").alias("above"))
    return within.join(above, ["g", up]).withColumn("base", F.col("base") + F.col("above")).drop(up, "above")


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``i``, the place of each leaf in its group by doc_id (null
    first). Rows of one id follow each other by digest."""
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    lower = F.expr("~shiftleft(-1L, cast(doc_id & 63 as int))")
    leaves = leaves.withColumn("word", F.shiftright("doc_id", 6))
    words = saved(leaves.where("doc_id is not null").groupBy("g", "word").agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")), "manifest-bitmaps")
    words = words.withColumn("box", F.shiftright("word", 9))
    boxes = _before(words.groupBy("g", "box").agg(F.sum("n").alias("n")), "box", 64 - 6 - 9)
    w = W.partitionBy("g", "box").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    words = (words.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0)))
             .join(boxes.select("g", "box", "base"), ["g", "box"])
             .select("g", "word", "bits", "n", (F.col("base") + F.col("inside")).alias("base")))
    found = (leaves.where("doc_id is not null").join(words.hint("shuffle_hash"), ["g", "word"])
             .withColumn("i", F.col("base") + F.bit_count(F.col("bits").bitwiseAND(lower))))
    out = ["g", "doc_id", "leaf", "shown"]
    nulls = leaves.where("doc_id is null")
    if nulls.isEmpty() and words.where(F.col("n") > F.bit_count("bits")).isEmpty():
        return found.select(*out, "i")
    return _with_repeats(found, nulls).select(*out, "i")


def _with_repeats(found: DataFrame, nulls: DataFrame) -> DataFrame:
    """Places where ids repeat or are null: the bitmap counts an id once, so
    further rows of earlier ids of its word are added, then the place among the
    rows of the id itself. Only words with repeats are grouped."""
    single = F.col("n") == F.bit_count("bits")
    rows = saved(found.where(~single).select("g", "word", "doc_id", "leaf", "shown", "i").unionByName(
        nulls.select("g", "word", "doc_id", "leaf", "shown", F.lit(0).cast("long").alias("i")))
        .withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
        .withColumn("rid", F.monotonically_increasing_id()), "manifest-repeats")
    same = rows.groupBy("g", "key", "leaf").agg(F.count(F.lit(1)).alias("m")).withColumn("cell", F.substring("leaf", 1, 3))
    same = running_before(same, ["g", "key"], "cell", ["leaf"], F.col("m"), "earlier").select("g", "key", "leaf", "earlier")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(4096)))
    rows = running_before(rows, ["g", "key", "leaf"], "cell", ["rid"], F.lit(1), "copy").join(same, ["g", "key", "leaf"])
    ids = rows.where("doc_id is not null").groupBy("g", "word", "doc_id").agg((F.count(F.lit(1)) - 1).alias("more"))
    w = W.partitionBy("g", "word").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)  # 64 ids
    ids = ids.withColumn("more", F.coalesce(F.sum("more").over(w), F.lit(0))).drop("word")
    rows = rows.join(ids, ["g", "doc_id"], "left").withColumn(
        "i", F.col("i") + F.coalesce("more", F.lit(0)) + F.col("earlier") + F.col("copy"))
    first = nulls.groupBy("g").agg(F.count(F.lit(1)).alias("ahead"))
    cols = ["g", "doc_id", "leaf", "shown", "i"]
    both = found.where(single).select(*cols).unionByName(rows.select(*cols)).join(first, "g", "left")
    return both.withColumn("i", F.col("i") + F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("ahead", F.lit(0))))


def digest(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def reduced(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """Levels of nodes, the given ones first: up to a single node if the block is
    the ``whole`` tree, ``DEPTH`` levels else."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= DEPTH:
        at = levels[-1]
        levels.append([digest(b"".join(at[k:k + FAN])) for k in range(0, len(at), FAN)])
    return levels


def siblings(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of a slot's ancestors in their runs."""
    out = []
    for level in levels[:-1]:
        run = slot - slot % FAN
        out.append((b"".join(level[run:slot]), b"".join(level[slot + 1:run + FAN])))
        slot //= FAN
    return out


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _slots(items: list[dict], name: str = "leaf") -> list[bytes]:
    nodes = [b""] * len(items)
    for x in items:
        nodes[x["slot"]] = x[name].encode()
    return nodes


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):  # one block at a time
            yield b.slice(k, 1).to_pylist()[0]


def _tops(batches):
    for r in _rows(batches):
        yield pa.RecordBatch.from_pydict(
            {"g": [r["g"]], "block": pa.array([r["block"]], pa.int64()), "whole": [r["whole"]],
             "top": [reduced(_slots(r["items"]), r["whole"])[-1][0].decode()]})


def _paths(batches):
    """Siblings above every node of a block: its own levels', then the block's."""
    for r in _rows(batches):
        levels = reduced(_slots(r["items"]), r["whole"])
        above = [(x["left"], x["right"]) for x in r["up"]]
        n = len(levels[0])
        ups = [[{"left": a.decode(), "right": z.decode()} for a, z in siblings(levels, s)]
               + [{"left": a, "right": z} for a, z in above] for s in range(n)]
        yield pa.RecordBatch.from_pydict(
            {"g": [r["g"]] * n, "block": pa.array([r["block"] * BLOCK + s for s in range(n)], pa.int64()),
             "path": pa.array(ups, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})


def _proofs(root: bytes):
    def run(batches):
        for r in _rows(batches):
            levels = reduced(_slots(r["items"]), r["whole"])
            above = [(x["left"].encode(), x["right"].encode()) for x in r["up"]]
            tail = b"".join(a + z for a, z in above)
            out = {k: [] for k in ("leaf", "proof_sha256", "folded_root", "verified")}
            for x in r["items"]:
                own = siblings(levels, x["slot"])
                top = folded(x["shown"].encode(), own + above)
                out["leaf"].append(x["leaf"])
                out["proof_sha256"].append(sha256(b"".join(a + z for a, z in own) + tail).hexdigest())
                out["folded_root"].append(top.decode())
                out["verified"].append(top == root)
            ids = pa.array([x["doc_id"] for x in r["items"]], pa.int64())
            same = {"subroot": [r["subroot"]] * len(ids), "root": [root.decode()] * len(ids)}
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **out, **same})
    return run


def _climb(nodes: DataFrame, sizes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Block tables of every round over ``nodes`` (g, i, leaf and further columns)
    and the top (g, top) of each group; ``sizes`` holds (g, n)."""
    rounds, tops = [], []
    most = sizes.agg(F.max("n")).first()[0]
    while True:
        extra = [c for c in nodes.columns if c not in ("g", "i")]
        item = F.struct((F.col("i") % BLOCK).cast("int").alias("slot"), *extra)
        blocks = nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("block")).agg(F.collect_list(item).alias("items"))
        blocks = saved(blocks.join(sizes.select("g", (F.col("n") <= BLOCK).alias("whole")), "g"), f"manifest-{name}")
        done = saved(blocks.mapInArrow(_tops, "g string, block long, whole boolean, top string"), f"manifest-{name}-tops")
        rounds.append(blocks)
        tops.append(done.where("whole").select("g", "top"))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = done.where("not whole").select("g", F.col("block").alias("i"), F.col("top").alias("leaf"))
        sizes = sizes.where(F.col("n") > BLOCK).select("g", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return rounds, out


PATH = "array<struct<left:string,right:string>>"


def _descend(rounds: list[DataFrame], group_up: DataFrame) -> DataFrame:
    """First round's blocks with ``up``, the siblings above each block; those above
    a whole group are ``group_up`` (g, up)."""
    below = None
    for blocks in reversed(rounds):
        withup = blocks.join(group_up, "g")
        if below is not None:
            withup = withup.join(below, ["g", "block"], "left").withColumn("up", F.coalesce("path", "up")).drop("path")
        if blocks is not rounds[0]:
            below = saved(withup.select("g", "block", "whole", "items", "up").mapInArrow(
                _paths, f"g string, block long, path {PATH}"), "manifest-paths")
    return withup


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and its check for every row of ``docs``.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``. Nulls in any column are part of the digest (``-``); a null
    language is a group of its own, first of all; a null id comes first in its
    group and is never tampered with. Rows of one id stand by digest; equal rows
    get a leaf each. Empty texts count as length 0, texts are hashed whole. An
    empty table gives no rows, further columns of ``docs`` are ignored.
    """
    leaves = saved(leaves_of(docs), "manifest-leaves")
    sizes = saved(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "manifest-sizes")
    if sizes.isEmpty():
        return leaves.select("doc_id", "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"),
                             F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"), F.lit(True).alias("verified"))
    rounds, subroots = _climb(ranked(leaves), sizes, "leaves")
    # Groups by name: counted by the first bytes of the name, then inside those.
    cell = subroots.withColumn("cell", F.substring(F.hex("g"), 1, 6))
    cells = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(
        F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = cell.withColumn("i", F.row_number().over(W.partitionBy("cell").orderBy("g")) - 1)
    named = saved(inside.join(cells, "cell").select("g", "top", (F.col("base") + F.col("i")).alias("i")), "manifest-groups")
    langs = named.select(F.lit("").alias("g"), "i", F.col("top").alias("leaf"))
    upper, root = _climb(langs, langs.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "roots")
    root = root.first()["top"].encode()
    none = docs.sparkSession.createDataFrame([("", [])], f"g string, up {PATH}")
    above = _descend(upper, F.broadcast(none)).select("g", "block", "whole", "items", "up").mapInArrow(
        _paths, f"g string, block long, path {PATH}")
    above = saved(named.join(above.select(F.col("block").alias("i"), F.col("path").alias("up")), "i").select(
        "g", "up", F.col("top").alias("subroot")), "manifest-above")  # written, so that Catalyst knows its size
    blocks = _descend(rounds, above).select("g", "block", "whole", "items", "up", "subroot")
    return blocks.mapInArrow(_proofs(root), "doc_id long, leaf string, proof_sha256 string, folded_root string, "
                             "verified boolean, subroot string, root string")
