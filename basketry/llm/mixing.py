"""Mixing sources to target weights by a low-discrepancy source schedule.

Slots 0, 1, 2, ... of the mix get golden-ratio points frac(i * phi); a point
falls into the interval of one source on the cumulative share axis, so every
stretch of the mix holds the sources in their shares. The slots of a source
are ranked, and rank r takes the source's r-th block: its documents, shuffled
by a hash, laid end to end and cut into blocks of equal words. A source whose
target exceeds its size runs through its blocks again.

Everything is a join or a sum of small rows (no texts): running sums over a
source go through the cells of ``running_before``, slots are ranked within
chunks of 65,536 slots, and documents meet slots on (source, block), a key
with a handful of rows at most however large the source is. Tables with one
row per source are the only ones that a window sorts as a whole.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketry.llm.common import WORD, hash_order, running_before, saved, with_row_id, word_count

CELLS = 4096       # of the share axis, for the interval lookup by an equi join
CHUNK = 1 << 16    # slots ranked together
_LOW = 1 << 20

getcontext().prec = 50
_PHI = (Decimal(5).sqrt() - 1) / 2
_PHI_LOW = float(_PHI)
_PHI_HIGH = float(_PHI * _LOW % 1)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From ``skey, source, source_size`` (a row per source): ``weight`` by
    rank in code point order (null last), and ``target``: ``share`` times all
    words by weight, at most ``most`` times the source's own words, the excess
    dealt to the others by weight until none is above.

    With the sources in order of cap/weight, filling the first j to their caps
    leaves level_j = (pool - their caps) / (remaining weights); that level
    rises while sources are full and falls after, so its maximum is the final
    level and ``target = least(cap, level * weight)``.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = s.withColumn("pool", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn(
        "level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.withColumn("target", F.round(F.least("cap", F.col("level") * F.col("weight")), 6)).select(
        "skey", "source", "source_size", "weight", "target")


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """Slots of the mix: ``skey, rank, slot``. ``plan`` has a row per source:
    ``skey, slots, lo`` (its slots and those of the sources before it; they
    add up to ``n_slots``). The golden-ratio sequence gives a source its slots
    to within a few; ranks it exceeds are left out, ranks it misses follow at
    the end."""
    spark = plan.sparkSession
    i = F.col("id")
    u = F.pmod(i, F.lit(_LOW)) * F.lit(_PHI_LOW) + F.floor(i / F.lit(_LOW)) * F.lit(_PHI_HIGH)
    pts = spark.range(n_slots).withColumn("u", u - F.floor(u)).withColumn(
        "at", F.least(F.floor(F.col("u") * F.lit(n_slots)), F.lit(n_slots - 1))).withColumn(
        "cell", F.floor(F.col("u") * CELLS))
    def cell(x):
        return F.greatest(F.floor(x * F.lit(float(CELLS)) / F.lit(float(n_slots))) + 0, F.lit(0))
    spans = plan.where("slots > 0").withColumn("cell", F.explode(F.sequence(
        F.greatest(cell(F.col("lo")) - 1, F.lit(0)), F.least(cell(F.col("lo") + F.col("slots")) + 1, F.lit(CELLS - 1)))))
    hit = pts.join(spans, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("slots")))
    hit = hit.withColumn("chunk", F.floor(F.col("id") / CHUNK)).select("skey", "chunk", "id", "slots")
    ranked = running_before(hit, ["skey"], "chunk", ["id"], F.lit(1), "rank")
    dealt = ranked.where("rank < slots").select("skey", "rank", F.col("id").alias("slot"))
    have = hit.groupBy("skey").agg(F.count(F.lit(1)).alias("have"))
    missing = (plan.where("slots > 0").join(have, "skey", "left").where("coalesce(have, 0) < slots")
               .withColumn("rank", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("slots") - 1)))
               .select("skey", "rank", (F.lit(n_slots) + F.col("rank")).alias("slot")))
    return dealt.unionByName(missing)


def mix(docs: DataFrame, block_words: int = 64, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source",
        row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)``. ``rows`` has a line per row of ``docs``: ``rid,
    doc_id, size, source, source_size, target, taken, first_slot`` (the first slot of
    the mix that takes it, null if none). ``pieces`` has a line
    per row and pass through its source: ``rid, epoch, slot`` (the first that
    takes it) ``, lo, hi`` (the words taken, a stretch from lo to hi).

    ``rid`` is the column ``row_id``, which tells the rows apart, if given, else made here.
    Size counts words, null text 0; a null source is a source of its own. A
    row without words takes part with nothing. Repeated rows count each; equal
    ones may swap places, which no result shows. Every source's taken words
    are its target, rounded down. No rows: empty results. Other columns of ``docs``,
    whatever their names, play no part.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                       word_count(F.col(f"`{text}`")).alias("size"),
                       (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid"))
    base = base.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    base = saved(hash_order(base, "doc_id"), "sized")
    laid = running_before(base, ["skey"], "cell", ["h", "doc_id", "size", "rid"], F.col("size"), "off")

    sizes = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    need = F.floor("target").cast("long")
    b, size = F.lit(block_words), F.col("source_size")
    plan = source_targets(sizes, weights, share, most).withColumn("need", need)
    plan = plan.withColumn("blocks", F.ceil(size / b)).withColumn(
        "full", F.when(size > 0, F.expr("need div source_size")).otherwise(0)).withColumn(
        "rest", F.col("need") - F.col("full") * size).withColumn(
        "slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / b)).withColumn(
        "lo", F.coalesce(F.sum("slots").over(W.orderBy("skey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = saved(plan, "plan")
    n_slots = int(plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).head()["n"])

    slots = schedule(plan.select("skey", "slots", "lo"), n_slots).join(
        plan.select("skey", "blocks", "full", "rest", "source_size"), "skey")
    slots = slots.select(
        "skey", "slot", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"),
        F.when(F.expr("rank div blocks") < F.col("full"), F.col("source_size")).otherwise(F.col("rest")).alias("limit"))
    cut = laid.where("size > 0").select(
        "rid", "skey", "size", "off", F.explode(F.sequence(
            F.floor(F.col("off") / b), F.floor((F.col("off") + F.col("size") - 1) / b))).alias("block"))
    end = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * b, F.col("limit"))
    start = F.greatest(F.col("off"), F.col("block") * b)
    taken = cut.join(slots, ["skey", "block"]).withColumn("start", start - F.col("off")).withColumn(
        "end", end - F.col("off")).where("end > start")
    pieces = saved(taken.groupBy("rid", "epoch").agg(
        F.min("slot").alias("slot"), F.min("start").alias("lo"), F.max("end").alias("hi")), "pieces")
    per_row = pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    rows = base.join(plan.select("skey", "source_size", "target"), "skey").join(per_row, "rid", "left").select(
        "rid", "doc_id", "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return rows, pieces


def mixed_rows(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """``docs`` as the mix takes them, in slot order: a row for every pass that
    takes words of a document, with those words as its text (the whole text
    unless the source's target ends within the document)."""
    numbered = with_row_id(docs, "__row")
    rows, pieces = mix(numbered, row_id="__row", text=text, **how)
    cut = rows.select(F.col("rid").alias("__row"), "size").join(
        pieces.withColumnRenamed("rid", "__row"), "__row").withColumnsRenamed({c: f"__{c}" for c in ("size", "slot", "lo", "hi", "epoch")})
    texts = numbered.join(cut, "__row")
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (F.col("__lo") + 1).cast("int"),
                    (F.col("__hi") - F.col("__lo")).cast("int"))
    whole = F.col("__hi") - F.col("__lo") == F.col("__size")
    texts = texts.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(words, " ")))
    texts = texts.withColumn(n_chars, F.when(whole, F.col(n_chars)).otherwise(F.length(text)))
    return texts.sortWithinPartitions("__slot").select(*docs.columns)
