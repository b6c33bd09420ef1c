"""Time-ordered per-user operators: sessions, last-N views, page-before-sale.

The reference pipes each user's clicks, sorted by time, through external
reducer scripts. A plain window partitioned by user would put every click of
a user into one task, so a user with a third of all clicks would be one giant
sort. The operators below avoid that:

* sessions and page-before-sale work on time cells as wide as the timeout
  or limit, where per-(user, cell) aggregates (map-side combined) decide the
  answer and only the small cell table is ordered;
* running counts are computed inside shares of equal row counts (a range
  partitioning of user and time) and offset by sums over one row per user and
  share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.sources.delimited import ctas_temp

_UNB = Window.unboundedPreceding
_CUR = Window.currentRow


def _order(ts: str, tiebreak) -> list[Column]:
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    return [F.col(ts)] + [F.col(t) for t in tb]


def _cell(ts: str, width: int) -> Column:
    """floor(ts / width) in whole numbers."""
    return F.expr(f"({ts} - pmod({ts}, {int(width)}L)) div {int(width)}L")


def balanced_prefix_sum(df: DataFrame, part: list[str], ts: str, value: Column, out: str,
                        tiebreak=None, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``part`` in (ts, tiebreak) order.

    The rows are range-partitioned by (part, ts, tiebreak), so every share
    holds about as many rows however they bunch up in time or on one key, and
    written to the shared folder with their share's number. Sums run inside
    (part, share) and are offset by the totals of earlier shares: one row per
    key and share. Without a tie-break that makes rows distinct, equal rows
    may swap their sums.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order(ts, tiebreak)
    x = df.withColumn("_v", value.cast("long")).repartitionByRange(n, *[F.col(p) for p in part], *order)
    x = ctas_temp(spark, x.withColumn("_share", F.spark_partition_id()), "ordered")
    w = Window.partitionBy(*part, "_share").orderBy(*order).rowsBetween(_UNB, _CUR)
    windowed = x.withColumn("_local", F.sum("_v").over(w))
    totals = x.groupBy(*part, "_share").agg(F.sum("_v").alias("_tot"))
    earlier = Window.partitionBy(*part).orderBy("_share").rowsBetween(_UNB, -1)
    totals = totals.select(*part, "_share", F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_off"))
    return (windowed.join(totals, [*part, "_share"]).withColumn(out, F.col("_off") + F.col("_local"))
                    .drop("_share", "_v", "_local", "_off"))


def balanced_prefix_sums(df: DataFrame, part: list[str], order: list[str], values: dict[str, Column],
                         partitions: int | None = None) -> DataFrame:
    """``df`` with an inclusive running sum per ``part``, in ``order``, for each of
    ``values`` (name -> column), as ``balanced_prefix_sum`` makes them: shares of
    equal row counts, whatever part of the rows one key holds."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in order]
    x = df.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(n, *[F.col(p) for p in part], *by)
    x = ctas_temp(spark, x.withColumn("_share", F.spark_partition_id()), "ordered")
    w = Window.partitionBy(*part, "_share").orderBy(*by).rowsBetween(_UNB, _CUR)
    earlier = Window.partitionBy(*part).orderBy("_share").rowsBetween(_UNB, -1)
    totals = x.groupBy(*part, "_share").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    totals = totals.select(*part, "_share", *[F.sum(f"_t_{k}").over(earlier).alias(f"_o_{k}") for k in values])
    x = x.select("*", *[F.sum(f"_v_{k}").over(w).alias(f"_l_{k}") for k in values]).join(totals, [*part, "_share"])
    zero = F.lit(0)
    return x.select(*df.columns, *[(F.coalesce(f"_l_{k}", zero) + F.coalesce(f"_o_{k}", zero)).alias(k) for k in values])


def sessionize(df: DataFrame, user: str, ts: str, timeout: int, out: str = "session_id") -> DataFrame:
    """Add ``out`` = ``<user>_<n>``: per user in time order, a gap greater
    than ``timeout`` (same unit as ``ts``, whole numbers) starts session n+1;
    n starts at 1.

    Rows with a NULL user or time are dropped (they belong to no session).
    An equal gap stays in the same session; equal times never split.

    Plan: time is cut into cells ``timeout`` wide. Two clicks of one cell
    are less than ``timeout`` apart, so a cell never splits. A cell starts a
    session exactly when the previous cell is empty (its clicks are then
    more than ``timeout`` back) or its last click is more than ``timeout``
    before this cell's first. So: one map-side combined aggregate per
    (user, cell) over the clicks counted for their own and for the next
    cell, written to the shared folder; a running count of starts over that
    table; and a join back on (user, cell). The clicks are scanned twice
    (aggregate, join); a user with a large share of them is spread over its
    cells.
    """
    width = max(int(timeout), 1)
    t = F.col(ts)
    rows = df.where(F.col(user).isNotNull() & t.isNotNull()).withColumn("_cell", _cell(ts, width))
    # each click counts for its own cell and, as "previous", for the next
    # cell: one map-side combined aggregate gives first, last and the
    # previous cell's last click of every cell, with no self join
    own = F.struct(F.col("_cell").alias("c"), F.lit(False).alias("prev"))
    nxt = F.struct((F.col("_cell") + 1).alias("c"), F.lit(True).alias("prev"))
    tagged = rows.select(user, ts, F.explode(F.array(own, nxt)).alias("_x"))
    cells = (tagged.groupBy(user, F.col("_x.c").alias("_cell"))
                   .agg(F.min(F.when(~F.col("_x.prev"), F.col(ts))).alias("_lo"),
                        F.max(F.when(F.col("_x.prev"), F.col(ts))).alias("_prev_hi"))
                   .where(F.col("_lo").isNotNull()))
    starts = cells.select(user, "_cell", F.when(
        F.col("_prev_hi").isNull() | (F.col("_lo") - F.col("_prev_hi") > F.lit(timeout)), 1).otherwise(0).alias("_start"))
    numbered = balanced_prefix_sum(starts, [user], "_cell", F.col("_start"), "_session_no")
    return (rows.join(numbered.select(user, "_cell", "_session_no"), [user, "_cell"], "inner")
                .withColumn(out, F.concat(F.col(user).cast("string"), F.lit("_"),
                                          F.col("_session_no").cast("string")))
                .drop("_cell", "_session_no"))


def last_n_before(df: DataFrame, user: str, ts: str, item: str, is_view: Column,
                  is_buy: Column, max_age: int, targets=None, n: int = 5,
                  tiebreak=None) -> DataFrame:
    """(purchased_item, lastviewed_item) for the last ``n`` views before each
    purchase of a target item by the same user, at most ``max_age`` older (same
    unit as ``ts``).

    Views are numbered per user (``balanced_prefix_sum``); a purchase
    that follows view number k explodes k-n+1..k and equi-joins (user, number),
    so the work is linear: n rows per purchase, never views x purchases.
    Decision: a purchase does not clear the list of views.
    """
    # one kind column for both branches: the numbered rows then have the same
    # columns for views and purchases, so Spark shuffles and sorts them once
    # (the second branch reuses the exchange)
    kind = (F.when(F.coalesce(is_view, F.lit(False)), F.lit("v"))
             .when(F.coalesce(is_buy, F.lit(False)), F.lit("b")))
    rows = (df.where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(ts).isNotNull())
              .withColumn("_kind", kind)
              .where(F.col("_kind").isNotNull())
              .select(user, ts, item, "_kind", *([tiebreak] if isinstance(tiebreak, str)
                                                 else list(tiebreak or []))))
    numbered = balanced_prefix_sum(rows, [user], ts, (F.col("_kind") == "v").cast("int"), "_vn",
                                   tiebreak=tiebreak)
    numbered = numbered.select(F.col(user).alias("_u"), F.col(ts).alias("_t"),
                               F.col(item).alias("_item"), "_kind", "_vn")
    views = numbered.where(F.col("_kind") == "v").select(
        "_u", F.col("_vn").alias("_j"), F.col("_t").alias("_vts"),
        F.col("_item").alias("lastviewed_item"))
    buys = numbered.where((F.col("_kind") == "b") & (F.col("_vn") > 0))
    if targets is not None:
        buys = buys.where(F.col("_item").isin(list(targets)))
    buys = buys.select(
        "_u", F.col("_t").alias("_bts"), F.col("_item").alias("purchased_item"),
        F.explode(F.sequence(F.greatest(F.col("_vn") - F.lit(n - 1), F.lit(1)),
                             F.col("_vn"))).alias("_j"))
    return (buys.join(views, ["_u", "_j"], "inner")
                .where(F.col("_bts") - F.col("_vts") <= F.lit(max_age))
                .select("purchased_item", "lastviewed_item"))


def purchase_after_page(df: DataFrame, user: str, ts: str, page_type: str, sale: str,
                        within: int, wanted: str = "review", tiebreak=None) -> DataFrame:
    """Distinct sale ids whose user saw a ``wanted`` page at most ``within``
    (same unit as ``ts``) earlier, at or before the sale in (ts, tiebreak)
    order.

    Time is cut into cells ``within`` wide. A qualifying page is either in
    the sale's own cell and ordered before the sale (then the cell's
    earliest wanted page qualifies) or in the previous cell and at most
    ``within`` older (then that cell's latest wanted page qualifies). So
    two per-(user, cell) aggregates decide every sale: map-side combined,
    no sort and no per-user window, and a hot user is spread over cells.
    """
    width = max(int(within), 1)
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    key = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tb)])
    rows = (df.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
              .withColumn("_cell", _cell(ts, width)))
    pages = (rows.where(F.col(page_type) == F.lit(wanted))
                 .groupBy(user, "_cell")
                 .agg(F.min(key).alias("_first_page"), F.max(ts).alias("_last_page_ts")))
    sales = rows.where(F.col(sale).isNotNull()).select(
        user, "_cell", F.col(ts).alias("_t"), key.alias("_key"), sale)
    same = pages.select(user, "_cell", "_first_page")
    prev = pages.select(user, (F.col("_cell") + 1).alias("_cell"), "_last_page_ts")
    j = sales.join(same, [user, "_cell"], "left").join(prev, [user, "_cell"], "left")
    hit = ((F.col("_first_page").isNotNull() & (F.col("_first_page") <= F.col("_key")))
           | (F.col("_last_page_ts").isNotNull()
              & (F.col("_t") - F.col("_last_page_ts") <= F.lit(within))))
    return j.where(hit).select(sale).distinct()


def abandoned_sessions(df: DataFrame, session: str, ts: str, page_type: str,
                       cart: str, checkout: str) -> DataFrame:
    """(session, pagecount) for sessions with a ``cart`` page and no
    ``checkout`` page after their last cart page. One aggregate per session
    with partial aggregation; nothing is collected.
    """
    g = df.groupBy(session).agg(
        F.count(F.lit(1)).alias("pagecount"),
        F.max(F.when(F.col(page_type) == F.lit(cart), F.col(ts))).alias("_last_cart"),
        F.max(F.when(F.col(page_type) == F.lit(checkout), F.col(ts))).alias("_last_checkout"))
    return (g.where(F.col("_last_cart").isNotNull()
                    & (F.col("_last_checkout").isNull()
                       | (F.col("_last_checkout") < F.col("_last_cart"))))
             .select(session, "pagecount"))


def recency_flag(df: DataFrame, last_day: str, today, days: int = 60, out: str = "recency") -> DataFrame:
    """1.0 if the last activity is less than ``days`` before ``today`` else 0.0."""
    return df.withColumn(out, F.when(F.datediff(F.lit(today).cast("date"), F.col(last_day)) < days,
                                     F.lit(1.0)).otherwise(F.lit(0.0)))


def distribute_sort(df: DataFrame, key: list[str], order: list[str],
                    partitions: int | None = None, together: bool = False) -> DataFrame:
    """DISTRIBUTE BY key SORT BY key, order: each key's rows contiguous and
    in order. Range partitioning on (key, order) is used by default: a key
    holding a large share of the rows spreads over neighbouring partitions (in
    order) instead of filling one task. With ``together`` all rows of a key
    are in one partition, as after hashing the key; then the rows of the
    largest key must fit one task's sort (which spills to disk)."""
    cols = [*key, *order]
    if together:
        r = df.repartition(partitions, *key) if partitions else df.repartition(*key)
        return r.sortWithinPartitions(*cols)
    r = (df.repartitionByRange(partitions, *cols) if partitions
         else df.repartitionByRange(*cols))
    return r.sortWithinPartitions(*cols)


def collect_ordered(df: DataFrame, key: list[str], order: list[str], value: str, chunk: int = 1000,
                    out: str = "items") -> DataFrame:
    """(key..., chunk_no, ``out``): each key's values in ``order`` as lists of at
    most ``chunk``; lists 0, 1, 2, ... put together are the whole. A key with any
    share of the rows is that many rows, never one. Rows with a null key are
    dropped; null values keep their place."""
    rows = df.dropna(subset=key)
    placed = balanced_prefix_sums(rows.select(*dict.fromkeys([*key, *order, value])), key, order, {"_n": F.lit(1).cast("long")})
    placed = placed.withColumn("_c", F.expr(f"(_n - 1) div {int(chunk)}"))
    g = placed.groupBy(*key, F.col("_c").alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("_l"))
    return g.select(*key, "chunk_no", F.transform("_l", lambda x: x["v"]).alias(out))
