"""Join operators beyond plain equi joins.

* ``before_after``: facts inside the window after / before each change
  point, per item, as differences of running sums over (item, day): facts and
  windows are never joined.
* ``join_tolerance`` / ``join_nonequi_residual``: equi key + residual.
* ``join_contains``: which names occur (case-insensitively) inside which
  texts. Every name has anchors that a text holding the name must hold as
  well; an equi join on the rarest gives candidates, verified on the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import HashFilter
from basketry.operators.sessions import balanced_prefix_sums
from basketry.sources.delimited import ctas_temp


def join_nonequi_residual(a: DataFrame, b: DataFrame, on: list[str], condition: Column,
                          how: str = "inner") -> DataFrame:
    """Equi join on ``on`` plus a residual predicate (evaluated in the join)."""
    cond = None
    for k in on:
        c = a[k] == b[k]
        cond = c if cond is None else cond & c
    return a.join(b, cond & condition, how)


def join_tolerance(a: DataFrame, b: DataFrame, on: list[str], qa: str, qb: str,
                   tol: float = 0.1) -> DataFrame:
    """Equi join where the two quantities differ by at most ``tol`` relative
    to their mean: |qa - qb| / ((qa + qb) / 2) <= tol."""
    j = a.join(b, on, "inner")
    mean = (F.col(qa) + F.col(qb)) / F.lit(2.0)
    return j.where(F.try_divide(F.abs(F.col(qa) - F.col(qb)), mean) <= F.lit(tol))


def join_scalar(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side (no join condition in the
    reference). Done without a join: the two rows are stacked and folded
    into one by a global aggregate over exactly two rows. Equal column names
    are refused."""
    if set(a.columns) & set(b.columns):
        raise ValueError(f"equal column names: {sorted(set(a.columns) & set(b.columns))}")
    cols = list(dict.fromkeys(a.columns + b.columns))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


EXACT = "decimal(38,6)"  # differences of running sums stay exact


def before_after(facts: DataFrame, changes: DataFrame, item: str, day: str, qty: str,
                 start: str, length: str, keys: list[str] | None = None,
                 split: Column | None = None, split_values=("F", "O")) -> DataFrame:
    """Per change point: sum of ``qty`` in [start, start+len) ("after") and
    in [start-len, start) ("before"); with ``split``, one pair per value.

    Facts never meet windows. They are summed by (item, day), the three bounds
    of every window join them as rows without a quantity, and one running sum per
    item (in shares of equal size, ``balanced_prefix_sums``) gives each bound the
    quantity of all earlier days; a window is the difference of two. So the work
    is facts + windows, also for an item that holds half of both. Quantities are
    summed to six decimals.
    """
    keys = list(keys or [])
    parts = {"": None} if split is None else {f"_{v}": v for v in split_values}
    d = F.col(day)
    daily = facts.where(F.col(item).isNotNull() & d.isNotNull()).groupBy(F.col(item).alias("_i"), d.alias("_d")).agg(*[
        F.sum(F.when(split == F.lit(v), F.col(qty)) if v is not None else F.col(qty)).cast(EXACT).alias(f"_q{n}")
        for n, v in parts.items()])
    ch = changes.select(F.col(item).alias("_i"), *keys, F.col(start).alias("_s"), F.col(length).alias("_len")).distinct()
    ch = ch.where(F.col("_i").isNotNull() & F.col("_s").isNotNull() & (F.col("_len") > 0))
    bounds = ch.select("_i", *keys, "_s", "_len", F.explode(F.array(
        F.struct(F.lit(-1).alias("w"), F.date_sub("_s", F.col("_len")).alias("d")), F.struct(F.lit(0).alias("w"), F.col("_s").alias("d")),
        F.struct(F.lit(1).alias("w"), F.date_add("_s", F.col("_len")).alias("d")))).alias("_b"))
    bounds = bounds.select("_i", *keys, "_s", "_len", F.col("_b.d").alias("_d"), F.col("_b.w").alias("_w"))
    # a bound comes before the facts of its day
    line = daily.withColumn("_k", F.lit(1)).unionByName(bounds.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    sums = balanced_prefix_sums(line, ["_i"], ["_d", "_k"], {f"_p{n}": F.col(f"_q{n}") for n in parts})
    at = sums.where("_k = 0").groupBy("_i", *keys, "_s", "_len").agg(*[
        F.max(F.when(F.col("_w") == w, F.col(f"_p{n}"))).alias(f"_{w + 1}{n}") for n in parts for w in (-1, 0, 1)])
    # every change point is kept, also those without any sale (sums 0)
    g = at.groupBy(F.col("_i").alias(item), *keys).agg(*[
        F.sum(F.col(f"_{w + 1}{n}") - F.col(f"_{w}{n}")).cast("double").alias(f"{name}{n}")
        for n in parts for name, w in (("after", 1), ("before", 0))])
    return changes.select(F.col(item), *keys).join(g, [item, *keys], "left").fillna(
        0, subset=[c for c in g.columns if c.startswith(("after", "before"))])


GRAM = 3  # characters of the anchors of names of fewer than three words


def _anchors(names: DataFrame, paired: bool) -> DataFrame:
    """``_n`` and ``_h``, the hashes of all its anchors: what a text that holds the
    name must hold. The inner words of a name (cut at single spaces) stand as
    whole words in the text, in the same order: they are its anchors, or, if
    ``paired``, their pairs of neighbours where there are any. A name without inner words has the grams
    of its words (shorter words: the word), which lie inside a word of the text;
    a name of spaces alone has the anchor of any text."""
    words = F.split("_n", " ")
    between = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    inner = F.filter(between, lambda w: w != "")
    pairs = (F.size(between) > 1) & F.lit(paired)
    outer = F.filter(words, lambda w: w != "")
    tags = F.when(pairs, _pairs(between)).when(F.size(inner) > 0, F.transform(inner, lambda w: F.xxhash64(F.lit("w"), w))).when(
        F.size(outer) > 0, F.transform(F.flatten(F.transform(outer, lambda w: grams_of(w))), lambda g: F.xxhash64(F.lit("g"), g))).otherwise(
        F.array(F.xxhash64(F.lit(""))))
    kind = F.when(pairs, "pair").when(F.size(inner) > 0, "word").when(F.size(outer) > 0, "gram").otherwise("any")
    shortest = F.when(kind == "gram", F.array_min(F.transform(outer, lambda w: F.least(F.length(w), F.lit(GRAM)))))
    return names.select("_n").distinct().select("_n", kind.alias("_kind"), shortest.alias("_shortest"),
                                                F.explode(F.array_distinct(tags)).alias("_h"))


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words."""
    bound = F.transform(F.array(words), lambda ws: F.zip_with(
        F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(F.lit("p"), a, b)))
    return F.get(bound, F.lit(0))  # bound once, not cut again at every use


def grams_of(word: Column, size: int = GRAM) -> Column:
    """Stretches of ``size`` characters; a shorter word as a whole."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (size - 1), F.lit(1))),
                       lambda i: F.substring(word, i, F.lit(size)))


def _held(texts: DataFrame, low: Column, anchors: DataFrame) -> DataFrame:
    """(_id, _h): anchors that the texts may hold. The bitmap of the names' anchors
    decides where the text is read; nothing else becomes a row."""
    may = HashFilter(anchors.select("_h", *[F.when(F.col("_kind") == k, GRAM - F.coalesce("_shortest", F.lit(0))).alias(f"_{k}")
                                            for k in ("pair", "word", "gram", "any")]), "_h", ("_pair", "_word", "_gram", "_any"))
    kinds = {k for k, v in may.most.items() if v is not None}
    words = texts.select("_id", F.explode(F.array_distinct(F.split(low, " "))).alias("_w"))
    parts = []
    if "_pair" in kinds:
        # not the bare column: Catalyst would infer a filter on its size and cut the text twice
        at = texts.select("_id", F.split(low, " ").alias("_ws")).select(
            "_id", "_ws", F.posexplode(F.slice("_ws", 1, 2 ** 31 - 1)).alias("_p", "_w"))
        parts.append(at.select("_id", F.xxhash64(F.lit("p"), "_w", F.get("_ws", F.col("_p") + 1)).alias("_h")))
    if "_word" in kinds:
        parts.append(words.select("_id", F.xxhash64(F.lit("w"), "_w").alias("_h")))
    if "_gram" in kinds:
        # shorter grams only if a name has a word that short
        for size in range(GRAM - may.most["_gram"], GRAM + 1):
            grams = words.where(F.length("_w") >= size).select("_id", F.explode(grams_of(F.col("_w"), size)).alias("_g"))
            parts.append(grams.select("_id", F.xxhash64(F.lit("g"), "_g").alias("_h")))
    if "_any" in kinds:
        parts.append(texts.where(low.isNotNull()).select("_id", F.xxhash64(F.lit("")).alias("_h")))
    out = texts.limit(0).select("_id", F.lit(0).cast("long").alias("_h"))
    for p in parts:
        out = out.unionByName(p.where(may.may_hold(F.col("_h"))))
    return out


def contains_candidates(text_df: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    """(_id, _n): text rows and names (``_n``, lower-cased) that share the name's
    rarest anchor.

    A text's anchors, as far as the names' bitmap lets them pass, are written as
    (id, hash) rows while it is read. One aggregate over those counts how many
    texts hold each anchor; a name keeps the rarest of its own, and goes if one
    of them occurs nowhere. Only rows of kept anchors are joined. If single words
    are too common for the names (by those counts there would be more candidates
    than texts with an anchor), the texts are read again for pairs of words."""
    spark = text_df.sparkSession
    texts = text_df.select(F.col(id_col).alias("_id"), F.lower(F.col(text)).alias("_low"))
    for paired in (False, True):
        anchors = _anchors(names, paired)
        held = ctas_temp(spark, _held(texts, F.col("_low"), anchors), "anchors-held")
        freq = held.groupBy("_h").agg(F.count(F.lit(1)).alias("_f"))
        rarest = (anchors.join(freq, "_h", "left").groupBy("_n")
                  .agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_h").alias("h"))).alias("_r"))
                  .where(F.col("_r.f") > 0).select("_n", F.col("_r.f").alias("_f"), F.col("_r.h").alias("_h")))
        if not paired:
            rarest = ctas_temp(spark, rarest, "anchors-rarest")
            expected = rarest.agg(F.sum("_f")).first()[0] or 0
            if expected <= held.agg(F.approx_count_distinct("_id")).first()[0]:
                break
    return held.join(rarest.drop("_f"), "_h").select("_id", "_n").distinct()


def join_contains(text_df: DataFrame, id_col: str, text: str, names_df: DataFrame, name: str,
                  carry: list[str] | tuple = (), out: str = "matched_name",
                  distinct_payload: bool = False) -> DataFrame:
    """Rows of ``text_df`` x names such that lower(name) occurs in lower(text).

    Output: all columns of ``text_df``, ``out`` (the lower-cased name) and
    the ``carry`` columns of the name row; one row per (text row, distinct
    name row); with ``distinct_payload`` one row per (text row, distinct
    payload), ``out`` being the first matching name in sort order. Empty and
    NULL names never match. ``id_col`` identifies the rows of ``text_df``.

    Candidates (``contains_candidates``) share the name's rarest anchor; they meet
    the texts on the id and are verified. Whether a join broadcasts is left to
    Catalyst and its sizes.
    """
    carry = list(carry)
    spark = text_df.sparkSession
    names = ctas_temp(spark, names_df.select(F.lower(F.col(name)).alias("_n"), *carry)
                      .where(F.col("_n").isNotNull() & (F.length("_n") > 0)).distinct(), "names")
    # written, so that Catalyst knows its size when it meets the texts
    cand = ctas_temp(spark, contains_candidates(text_df, id_col, text, names).join(names, "_n")
                     .select("_id", "_n", *carry), "candidates")
    low = F.lower(F.col(text))
    if distinct_payload:
        # Names of one payload: an argument table, not data that grows per row.
        cand = cand.groupBy("_id", *carry).agg(F.array_sort(F.collect_set("_n")).alias("_ns"))
        hits = text_df.join(cand, F.col(id_col) == F.col("_id"))
        found = F.filter("_ns", lambda n: F.contains(low, n))
        hits = hits.withColumn(out, F.get(found, 0)).where(F.col(out).isNotNull())
    else:
        hits = text_df.join(cand, F.col(id_col) == F.col("_id")).where(F.contains(low, F.col("_n")))
        hits = hits.withColumn(out, F.col("_n"))
    return hits.select(*text_df.columns, out, *carry)
