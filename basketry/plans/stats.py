"""Statistics jobs (reference q11, q14, q15, q23, q24): correlation, one-pass
ratios, regression slopes, coefficient of variation, price elasticity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.aggregates import agg_corr, agg_linreg
from basketry.operators.filters import date_range_filter, month_range
from basketry.operators.joins import before_after
from basketry.sources.tables import money, net_paid, table


def q11_review_corr(spark: SparkSession, sf_dir: str, start: str = "2024-01-01",
                    end: str = "2024-01-31") -> DataFrame:
    """corr(activity count, mean value) over users with a purchase in [start, end]."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value", "ts")
    buyers = (e.where((F.col("event_type") == "purchase")
                      & F.col("ts").cast("date").between(F.lit(start).cast("date"),
                                                         F.lit(end).cast("date")))
               .select("user_id"))
    per_user = (e.where(F.col("user_id").isNotNull())
                 .join(buyers, "user_id", "left_semi")
                 .groupBy("user_id")
                 .agg(F.count(F.lit(1)).alias("n_events"),
                      (F.sum(money("value")).cast("double") / F.count("value")).alias("avg_value")))
    return agg_corr(per_user, "n_events", "avg_value").select(
        F.round("corr", 9).alias("review_corr"))


def q14_am_pm_ratio(spark: SparkSession, sf_dir: str, am=(7, 8), pm=(19, 20),
                    value_min: float = 1.0, value_max: float = 20.0) -> DataFrame:
    """Morning/evening event ratio for values in a band, one pass."""
    e = (table(spark, sf_dir, "events", "ts", "value")
         .where(F.col("value").between(value_min, value_max)))
    h = F.hour("ts")
    g = e.agg(F.count(F.when(h.between(*am), 1)).alias("am_count"),
              F.count(F.when(h.between(*pm), 1)).alias("pm_count"))
    return g.select("am_count", "pm_count",
                    F.try_divide(F.col("am_count").cast("double"), F.col("pm_count").cast("double"))
                     .cast("decimal(15,4)").alias("am_pm_ratio"))


def q15_declining_category(spark: SparkSession, sf_dir: str, start: str = "1997-01-01",
                           end: str = "1997-12-31", store: int = 10) -> DataFrame:
    """Categories whose daily net sales in one store have slope <= 0.

    x is the day number from ``start`` (keeps x*x small and exact); the slope
    equals the one over raw day keys, the intercept is at ``start``.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_extendedprice", "l_discount").where(F.col("l_suppkey") == store)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").where(
        F.col("o_orderdate").between(F.to_timestamp_ntz(F.lit(start)),
                                     F.to_timestamp_ntz(F.lit(f"{end} 23:59:59.999999"))))
    p = table(spark, sf_dir, "part", "p_partkey", "p_type").where(F.col("p_type").isNotNull())
    daily = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
               .groupBy(F.col("p_type").alias("cat"),
                        F.datediff(F.col("o_orderdate").cast("date"),
                                   F.lit(start).cast("date")).alias("x"))
               .agg(F.sum(net_paid()).cast("double").alias("y")))
    reg = agg_linreg(daily, ["cat"], "x", "y")
    return (reg.where(F.col("slope") <= 0)
               .select("cat", F.round("slope", 7).alias("slope"),
                       F.round("intercept", 7).alias("intercept"))
               .orderBy("cat"))


def q23_inventory_cov(spark: SparkSession, sf_dir: str, year: int = 1997, month: int = 1,
                      coefficient: float = 0.6) -> DataFrame:
    """(supplier nation, category) groups whose shipped quantity has
    coefficient of variation >= c in month m and in month m+1."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    li = date_range_filter(li, "l_shipdate", *month_range(year, month, month + 1))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_type")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    # both months from one aggregate: other months' quantities are NULL
    moy = F.month("l_shipdate")
    g = x.groupBy(F.col("s_nationkey").alias("warehouse"), F.col("p_type").alias("item")).agg(*[
        f(F.when(moy == m, F.col("l_quantity"))).cast("decimal(15,5)").alias(f"{n}{m}")
        for m in (month, month + 1) for n, f in (("sd", F.stddev_samp), ("mu", F.avg))])

    def cov(m):
        return F.when(F.col(f"mu{m}") > 0, F.col(f"sd{m}").cast("double") / F.col(f"mu{m}").cast("double"))
    return (g.where((cov(month) >= coefficient) & (cov(month + 1) >= coefficient))
             .select("warehouse", "item", F.lit(month).alias("d_moy"), cov(month).cast("decimal(15,5)").alias("cov"),
                     F.lit(month + 1).alias("d_moy_consecutive"),
                     cov(month + 1).cast("decimal(15,5)").alias("cov_consecutive"))
             .orderBy("warehouse", "item"))


def market_prices(part: DataFrame, windows: int = 2) -> DataFrame:
    """Competitor price windows derived from the part table (the test tables
    have none): per part ``windows`` windows with a start day, a length in
    days and a relative price change in -0.10 .. +0.10 (0 happens)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("k")
    x = part.select("p_partkey", k)
    return x.select(
        "p_partkey",
        (F.col("p_partkey") * windows + F.col("k")).alias("imp_sk"),
        F.date_add(F.lit("1995-06-01").cast("date"),
                   F.pmod(F.col("p_partkey") * 37 + F.col("k") * 401, F.lit(2000)).cast("int"))
         .alias("imp_start_date"),
        (F.lit(30) + F.pmod(F.col("p_partkey") + F.col("k") * 7, F.lit(60))).cast("int")
         .alias("no_days_comp_price"),
        ((F.pmod(F.col("p_partkey") * 13 + F.col("k") * 5, F.lit(21)) - 10) / F.lit(100.0))
         .alias("price_change"))


def cross_price_elasticity(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Per item: mean over its competitor price changes of
    (quantity after - quantity before) / (quantity before x price change),
    both channels together; a zero change or no sales before gives NULL.

    ``sales``: item, sold (date), qty, ch ('F'/'O'); ``changes``: item,
    imp_sk, imp_start_date, no_days_comp_price, price_change.
    """
    ba = before_after(sales, changes, "item", "sold", "qty", "imp_start_date",
                      "no_days_comp_price", keys=["imp_sk", "price_change"], split=F.col("ch"))
    cur = F.col("after_F") + F.col("after_O")
    prev = F.col("before_F") + F.col("before_O")
    e = F.try_divide(cur - prev, prev * F.col("price_change"))
    return (ba.groupBy(F.col("item").alias("i_item_sk"))
              .agg(F.avg(e).alias("_e"))
              .select("i_item_sk", F.col("_e").cast("decimal(15,7)").alias("cross_price_elasticity")))


def q24_price_elasticity(spark: SparkSession, sf_dir: str, p_type: str = "ECONOMY") -> DataFrame:
    """Cross-price elasticity per part of one category against the derived
    competitor price windows."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_type").where(F.col("p_type") == p_type)
    changes = market_prices(p.select("p_partkey")).withColumnRenamed("p_partkey", "item")
    return cross_price_elasticity(sales_near(spark, sf_dir, changes), changes)


def sales_near(spark: SparkSession, sf_dir: str, changes: DataFrame) -> DataFrame:
    """Sales (item, sold, qty, ch) of items with a price change: the items
    restrict ``lineitem`` before it meets ``orders``."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linestatus")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    li = li.join(changes.select("item").distinct(), F.col("l_partkey") == F.col("item"), "left_semi")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_partkey").alias("item"), F.col("o_orderdate").cast("date").alias("sold"),
                      F.col("l_quantity").alias("qty"), F.col("l_linestatus").alias("ch")))
