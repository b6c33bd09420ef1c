"""Market-basket operators: item pairs per basket and their counts.

``make_pairs`` replaces the reference's pair-making table function. It is a
distinct + self equi-join on the basket key with ``item_1 < item_2``, so the
smaller item is always on the left and a pair is never emitted twice.

Scale notes
-----------
* The distinct (basket, item) step is a hash aggregate with map-side partial
  aggregation; duplicates inside a basket never cross the network twice.
* ``min_support`` prunes items before pairing (a pair cannot occur in more
  baskets than either of its items), which is exact for "count > n" filters
  and removes most of the quadratic work on long-tailed item sets.
* A basket of more than ``HOT`` distinct items is dealt to as many shares as
  it has thousands: its left side by item hash, its right side to all of them.
  Other baskets have one share. So no task pairs a whole hot basket, and only
  hot baskets are replicated.
* Pairs that can't reach the wanted count are refused by hashed bucket counts
  (``heavy_pairs``) before they are shuffled for the exact one, as long as the
  pairs are few enough for the fixed number of buckets to refuse most of them.
* The pair counts are aggregated with partial aggregation before the final
  shuffle, so the shuffled volume is bounded by distinct pairs per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import MOST, HashFilter
from basketry.sources.delimited import ctas_temp


def basket_items(df: DataFrame, basket: str, item: str,
                 min_support: int | None = None) -> DataFrame:
    """Distinct non-null (basket, item) rows, optionally only frequent items."""
    d = (df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
           .where(F.col("basket").isNotNull() & F.col("item").isNotNull())
           .distinct())
    if min_support is not None and min_support > 1:
        frequent = (d.groupBy("item").agg(F.count(F.lit(1)).alias("n_baskets"))
                      .where(F.col("n_baskets") >= F.lit(min_support))
                      .select("item"))
        d = d.join(frequent, "item", "left_semi")
    return d


HOT = 1000  # distinct items of a basket per task, when pairing


def make_pairs(df: DataFrame, basket: str, item: str, min_support: int | None = None,
               hot: int = HOT) -> DataFrame:
    """(basket, item_1, item_2) for every two distinct items of a basket, item_1 < item_2."""
    return _paired(basket_items(df, basket, item, min_support), hot)


def _paired(d: DataFrame, hot: int) -> DataFrame:
    large = (d.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).alias("_shares"))
               .where(F.col("_shares") > 1))
    d = d.join(large, "basket", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))
    left = d.select("basket", F.col("item").alias("item_1"),
                    F.pmod(F.xxhash64("item"), F.col("_shares")).alias("_salt"))
    right = d.select("basket", F.col("item").alias("item_2"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_salt"))
    return (left.join(right, ["basket", "_salt"], "inner")
                .where(F.col("item_1") < F.col("item_2"))
                .select("basket", "item_1", "item_2"))


def heavy_pairs(pairs: DataFrame, min_count: int) -> DataFrame:
    """Rows of ``pairs`` that may belong to a pair of more than ``min_count`` rows.

    Pairs are hashed two ways into ``MOST`` buckets each and counted there (a few
    bytes a bucket and task leave the map side). A pair in a bucket that counts
    ``min_count`` at most is light itself; only pairs heavy both ways go on to the
    exact count. The buckets' bitmaps have a fixed size."""
    keys = [F.xxhash64("item_1", "item_2"), F.xxhash64("item_2", F.lit("b"), "item_1")]
    buckets = [h.bitwiseAND(F.lit(MOST - 1)) for h in keys]
    counted = pairs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("way"), b.alias("b")) for i, b in enumerate(buckets)])).alias("x"))
    counted = counted.groupBy("x.way", "x.b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > min_count)
    counted = ctas_temp(pairs.sparkSession, counted, "pair-buckets")
    for i, b in enumerate(buckets):
        pairs = pairs.where(HashFilter(counted.where(F.col("way") == i), "b", bits=MOST).may_hold(b))
    return pairs


def pair_counts(df: DataFrame, basket: str, item: str, min_count: int | None = None,
                names: tuple[str, str] = ("item_1", "item_2")) -> DataFrame:
    """Number of baskets per item pair; ``min_count`` keeps pairs with cnt > min_count."""
    support = (min_count + 1) if min_count is not None else None
    d = basket_items(df, basket, item, support)
    if min_count is not None and min_count > 0:
        # read several times: the sizes, and the pairs once or twice
        d = ctas_temp(df.sparkSession, d, "basket-items")
        n = F.col("n")
        largest, total = d.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).agg(
            F.max(n), F.sum(n.cast("double") * (n - 1) / 2)).first()
        if (largest or 0) <= HOT:
            pairs = d.select("basket", F.col("item").alias("item_1")).join(
                d.select("basket", F.col("item").alias("item_2")), "basket").where("item_1 < item_2")
        else:
            pairs = _paired(d, HOT)
        # beyond that most buckets are heavy, and counting them would only cost
        if (total or 0) <= MOST * min_count:
            pairs = heavy_pairs(pairs, min_count)
    else:
        pairs = _paired(d, HOT)
    out = pairs.groupBy("item_1", "item_2").agg(F.count(F.lit(1)).alias("cnt"))
    if min_count is not None:
        out = out.where(F.col("cnt") > F.lit(min_count))
    return out.select(F.col("item_1").alias(names[0]), F.col("item_2").alias(names[1]), "cnt")


def pairs_in_row(df: DataFrame, items: str) -> DataFrame:
    """Explode (item_1, item_2), item_1 < item_2, from an array column of
    distinct items (in-row pairing, for sets from a bounded domain)."""
    arr = F.array_sort(F.array_distinct(F.col(items)))
    n = F.size(arr)
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(F.slice(arr, i + 1, n),
                              lambda y: F.struct(F.element_at(arr, i).alias("item_1"),
                                                 y.alias("item_2")))))
    return (df.select("*", F.explode(F.when(n > 1, pairs)).alias("_p"))
              .select("*", "_p.item_1", "_p.item_2").drop("_p", items))


def pair_counts_bounded(df: DataFrame, basket: str, item: str, min_count: int | None = None,
                        names: tuple[str, str] = ("item_1", "item_2")) -> DataFrame:
    """``pair_counts`` for items from a domain that the caller knows to be
    bounded (categories, page types, classes; use ``pair_counts`` otherwise): the distinct items of a basket are collected map-side
    (never more than the domain per basket and task, however large the
    basket), paired inside the row and counted. One grouped shuffle and no
    join, against distinct + self join + count for unbounded items."""
    sets = (df.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
              .groupBy(F.col(basket).alias("basket"))
              .agg(F.collect_set(item).alias("_items")))
    out = pairs_in_row(sets, "_items").groupBy("item_1", "item_2").agg(
        F.count(F.lit(1)).alias("cnt"))
    if min_count is not None:
        out = out.where(F.col("cnt") > F.lit(min_count))
    return out.select(F.col("item_1").alias(names[0]), F.col("item_2").alias(names[1]), "cnt")


def viewed_with_item(df: DataFrame, session: str, item: str, target) -> DataFrame:
    """(session, item) rows of sessions that also contain ``target``; target excluded.

    A semi join on the sessions that hold the target replaces
    ``array_contains(collect_set(...))``: no session is ever collected into
    one row, so a very long session is not a problem.
    """
    rows = (df.select(F.col(session).alias("session"), F.col(item).alias("item"))
              .where(F.col("session").isNotNull() & F.col("item").isNotNull()))
    hit = rows.where(F.col("item") == F.lit(target)).select("session").distinct()
    return (rows.join(hit, "session", "left_semi")
                .where(F.col("item") != F.lit(target))
                .distinct())


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """Order by a full tie-break and keep ``k`` rows (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)
