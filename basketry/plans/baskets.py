"""Basket and click-path jobs (reference q01, q02, q03, q04, q08, q12, q29, q30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.basket import pair_counts_bounded, top_k, viewed_with_item
from basketry.operators.sessions import (abandoned_sessions, last_n_before,
                                         purchase_after_page, sessionize)
from basketry.plans.common import DAY_S, lit_date, s_to_us
from basketry.sources.delimited import ctas_temp
from basketry.sources.tables import clicks, epoch_micros, money, table


def q01_sold_together(spark: SparkSession, sf_dir: str, categories=None, stores=None,
                      min_count: int = 5, limit: int = 100) -> DataFrame:
    """Item classes (brand/type) often on one ticket: pairs with cnt > min_count."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    if stores is not None:
        li = li.where(F.col("l_suppkey").isin(list(stores)))
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    if categories is not None:
        p = p.where(F.col("p_type").isin(list(categories)))
    sold = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", F.concat_ws("/", "p_brand", "p_type").alias("item_class"))
    # item classes are brand x type: a bounded domain, paired in-row
    pairs = pair_counts_bounded(sold, "l_orderkey", "item_class", min_count=min_count,
                                names=("item_1", "item_2"))
    return top_k(pairs, [F.col("cnt").desc(), "item_1", "item_2"], limit)


def q02_viewed_with_item(spark: SparkSession, sf_dir: str, target: int = 10,
                         timeout_s: int = DAY_S, limit: int = 30) -> DataFrame:
    """Items seen in the same session as ``target``, most frequent first.

    Decision: the test clicks are sparse (about two a day per user), so the
    default timeout is one day instead of one hour.
    """
    c = clicks(spark, sf_dir).where(F.col("item").isNotNull())
    s = sessionize(c, "user_id", "ts_us", s_to_us(timeout_s))
    # distinct (session, item) once: both sides of the semi join read it
    s = ctas_temp(spark, s.select("session_id", "item").distinct(), "session-items")
    together = viewed_with_item(s, "session_id", "item", target)
    return top_k(together.groupBy(F.col("item").alias("viewed_item"))
                         .agg(F.count(F.lit(1)).alias("cnt"))
                         .withColumn("target_item", F.lit(target).cast("long")),
                 [F.col("cnt").desc(), "viewed_item"], limit)


def q03_views_before_buy(spark: SparkSession, sf_dir: str, targets=None, n: int = 5,
                         range_s: int = 10 * DAY_S, limit: int = 100) -> DataFrame:
    """Last ``n`` items viewed at most ``range_s`` before buying a target item."""
    c = clicks(spark, sf_dir)
    pv = last_n_before(c, "user_id", "ts_us", "item",
                       is_view=F.col("event_type") == "view",
                       is_buy=F.col("event_type") == "purchase",
                       max_age=s_to_us(range_s), targets=targets, n=n, tiebreak="event_id")
    g = pv.groupBy("purchased_item", "lastviewed_item").agg(F.count(F.lit(1)).alias("cnt"))
    return top_k(g, [F.col("cnt").desc(), "purchased_item", "lastviewed_item"], limit)


def q04_abandoned_carts(spark: SparkSession, sf_dir: str, timeout_s: int = 6 * 3600,
                        cart: str = "click", checkout: str = "purchase") -> DataFrame:
    """Mean pages of sessions with a cart page and no checkout after it."""
    c = clicks(spark, sf_dir)
    s = sessionize(c, "user_id", "ts_us", s_to_us(timeout_s))
    ab = abandoned_sessions(s, "session_id", "ts_us", "event_type", cart, checkout)
    return ab.agg(F.count(F.lit(1)).alias("abandoned_sessions"),
                  (F.sum("pagecount") / F.count(F.lit(1))).cast("decimal(20,1)").alias("average_pages"))


def q08_review_effect(spark: SparkSession, sf_dir: str, start: str = "2024-01-01",
                      end: str = "2024-01-31", within_s: int = 3 * DAY_S,
                      review: str = "view", sale: str = "purchase") -> DataFrame:
    """Sales amount after a review page view (within ``within_s``) vs. the rest."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    e = e.where(F.col("ts").cast("date").between(lit_date(start), lit_date(end)))
    c = e.select("event_id", "user_id", "event_type", "value",
                 epoch_micros("ts").alias("ts_us"),
                 F.when(F.col("event_type") == sale, F.col("event_id")).alias("sale_id"))
    hits = purchase_after_page(c, "user_id", "ts_us", "event_type", "sale_id",
                               wanted=review, within=s_to_us(within_s), tiebreak="event_id")
    sales = c.where(F.col("sale_id").isNotNull()).select("sale_id", money("value").alias("amount"))
    flagged = sales.join(hits.withColumn("_hit", F.lit(True)), "sale_id", "left")
    review_amt = F.coalesce(F.sum(F.when(F.col("_hit"), F.col("amount"))), F.lit(0).cast("decimal(15,2)"))
    return flagged.agg(review_amt.cast("double").alias("review_sales_amount"),
                       (F.sum("amount") - review_amt).cast("double").alias("no_review_sales_amount"))


def q12_view_then_store(spark: SparkSession, sf_dir: str, start: str = "2024-01-01",
                        view_days: int = 10, buy_days: int = 30,
                        categories=(1, 2)) -> DataFrame:
    """Users who viewed an item of the categories in the first ``view_days``
    and bought one (later) within ``buy_days``.

    "Some view before some purchase" equals "first view before last
    purchase", so one aggregate per user replaces the views x purchases join.
    Category = item div 10.
    """
    c = clicks(spark, sf_dir, first=start, days=max(view_days, buy_days)).where(
        F.col("user_id").isNotNull() & F.floor(F.col("item") / 10).isin(list(categories)))
    t0 = epoch_micros(lit_date(start))
    in_days = lambda d: (F.col("ts_us") >= t0) & (F.col("ts_us") < t0 + F.lit(s_to_us(d * DAY_S)))
    per_user = c.groupBy("user_id").agg(
        F.min(F.when((F.col("event_type") == "view") & in_days(view_days), F.col("ts_us"))).alias("_first_view"),
        F.max(F.when((F.col("event_type") == "purchase") & in_days(buy_days), F.col("ts_us"))).alias("_last_buy"))
    return (per_user.where(F.col("_first_view") < F.col("_last_buy"))
                    .select(F.col("user_id").alias("u_id")).orderBy("u_id"))


def q29_bought_together_cat(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """Category pairs bought in one order."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_type")
    sold = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "p_type")
    pairs = pair_counts_bounded(sold, "l_orderkey", "p_type", names=("category_1", "category_2"))
    return top_k(pairs, [F.col("cnt").desc(), "category_1", "category_2"], limit)


def q30_viewed_together_cat(spark: SparkSession, sf_dir: str, timeout_s: int = 3600,
                            limit: int = 100) -> DataFrame:
    """Page-type pairs seen in one session."""
    c = clicks(spark, sf_dir).where(F.col("event_type").isNotNull())
    s = sessionize(c, "user_id", "ts_us", s_to_us(timeout_s))
    pairs = pair_counts_bounded(s, "session_id", "event_type",
                                names=("category_1", "category_2"))
    return top_k(pairs, [F.col("cnt").desc(), "category_1", "category_2"], limit)
