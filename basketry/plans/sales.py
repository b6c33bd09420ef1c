"""Star-schema sales jobs (reference q06, q07, q09, q13, q16, q17, q21, q22).

Where the reference computes two aggregates over the same facts and joins
them (store vs. web, year 1 vs. year 2, promoted vs. all), we compute one
conditional aggregate in one pass: one shuffle instead of two plus a join.
Money is summed as exact decimals; ratios are taken on doubles of the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.aggregates import agg_conditional
from basketry.operators.basket import top_k
from basketry.operators.filters import date_range_filter, days_around, filter_disjunctive, month_range
from basketry.sources.tables import money, net_paid, table


def _lines_with_orders(spark, sf_dir, *li_cols, year_from=None, year_to=None):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", *li_cols)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    if year_from is not None:
        o = date_range_filter(o, "o_orderdate", f"{year_from}-01-01", f"{year_to}-12-31")
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")


def _growth(x: DataFrame, key: str, measure, year: int) -> DataFrame:
    """Per key: first/second year totals of store ('F') and web ('O') lines."""
    yr, ch = F.year("o_orderdate"), F.col("l_linestatus")
    return agg_conditional(x, [key], {
        "store_first": ((ch == "F") & (yr == year), measure),
        "store_second": ((ch == "F") & (yr == year + 1), measure),
        "web_first": ((ch == "O") & (yr == year), measure),
        "web_second": ((ch == "O") & (yr == year + 1), measure),
    }, zero=True).where((F.col("store_first") > 0) & (F.col("web_first") > 0))


def _ratio(a: str, b: str):
    return F.col(a).cast("double") / F.col(b).cast("double")


def q06_channel_shift(spark: SparkSession, sf_dir: str, year: int = 1996,
                      limit: int = 100) -> DataFrame:
    """Customers whose web growth beats their store growth (profit-like measure)."""
    x = _lines_with_orders(spark, sf_dir, "l_extendedprice", "l_discount", "l_tax",
                           "l_linestatus", year_from=year, year_to=year + 1)
    ext, disc, tax = money("l_extendedprice"), money("l_discount"), money("l_tax")
    measure = (ext - ext * tax - ext * disc) + ext * (F.lit(1) - disc)
    g = _growth(x, "o_custkey", measure, year)
    g = g.where(_ratio("web_second", "web_first") > _ratio("store_second", "store_first"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    out = g.join(c, g.o_custkey == c.c_custkey).select(
        _ratio("web_second", "web_first").alias("_r"), "c_custkey", "c_name",
        "c_mktsegment", "c_nationkey")
    return (top_k(out, [F.col("_r").desc(), "c_custkey"], limit)
            .select(F.col("_r").cast("decimal(15,1)").alias("web_sales_increase_ratio"),
                    "c_custkey", "c_name", "c_mktsegment", "c_nationkey"))


def q07_pricey_states(spark: SparkSession, sf_dir: str, ratio: float = 1.03, year: int = 1997,
                      month: int | None = None, min_count: int = 10, limit: int = 10) -> DataFrame:
    """Nations with at least ``min_count`` buys of items priced above
    ``ratio`` x their category's mean price."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_retailprice")
    cat = p.groupBy("p_type").agg(F.sum(money("p_retailprice")).alias("_sum"),
                                  F.count(F.lit(1)).alias("_n"))
    # price > ratio * sum / n, kept exact: price * n > sum * ratio
    pricey = (p.join(cat, "p_type")
               .where(money("p_retailprice") * F.col("_n")
                      > F.col("_sum") * F.lit(ratio).cast("decimal(10,4)"))
               .select("p_partkey"))
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    o = date_range_filter(o, "o_orderdate", *month_range(year, month or 1, month or 12))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    x = (li.join(pricey, li.l_partkey == pricey.p_partkey, "left_semi")
           .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
           .join(c, F.col("o_custkey") == F.col("c_custkey"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .where(F.col("n_name").isNotNull()))
    g = (x.groupBy(F.col("n_name").alias("ca_state")).agg(F.count(F.lit(1)).alias("cnt"))
          .where(F.col("cnt") >= min_count))
    return top_k(g, [F.col("cnt").desc(), "ca_state"], limit)


# q09 bands: (customer segment, extended price range) and (nations, net paid range)
Q09_SEGMENT_BANDS = [("AUTOMOBILE", 1000, 30000), ("BUILDING", 5000, 40000),
                     ("MACHINERY", 10000, 50000)]
Q09_NATION_BANDS = [((0, 5, 10), 0, 20000), ((1, 6, 11), 15000, 30000),
                    ((2, 7, 12), 5000, 25000)]


def q09_segment_quantity(spark: SparkSession, sf_dir: str, year: int = 1997) -> DataFrame:
    """Total quantity of lines inside OR-ed (segment, price) and (nation, net) bands."""
    x = _lines_with_orders(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount",
                           year_from=year, year_to=year)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    x = x.join(c, x.o_custkey == c.c_custkey).withColumn("_net", net_paid())
    x = filter_disjunctive(x, [[("c_mktsegment", "=", s), ("l_extendedprice", "between", (lo, hi))]
                               for s, lo, hi in Q09_SEGMENT_BANDS])
    x = filter_disjunctive(x, [[("c_nationkey", "in", ns), ("_net", "between", (lo, hi))]
                               for ns, lo, hi in Q09_NATION_BANDS])
    return x.agg(F.sum("l_quantity").cast("long").alias("total_quantity"))


def q13_yoy_growth(spark: SparkSession, sf_dir: str, year: int = 1996,
                   limit: int = 100) -> DataFrame:
    """As q06 on net paid; both growth ratios reported."""
    x = _lines_with_orders(spark, sf_dir, "l_extendedprice", "l_discount", "l_linestatus",
                           year_from=year, year_to=year + 1)
    g = _growth(x, "o_custkey", net_paid(), year)
    g = g.where(_ratio("web_second", "web_first") > _ratio("store_second", "store_first"))
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    out = g.join(c, g.o_custkey == c.c_custkey).select(
        "c_custkey", "c_name",
        _ratio("store_second", "store_first").alias("_rs"),
        _ratio("web_second", "web_first").alias("_rw"))
    return (top_k(out, [F.col("_rw").desc(), "c_custkey"], limit)
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("customer_name"),
                    F.col("_rs").cast("decimal(15,2)").alias("store_sales_increase_ratio"),
                    F.col("_rw").cast("decimal(15,2)").alias("web_sales_increase_ratio")))


def q16_price_change_sales(spark: SparkSession, sf_dir: str, day: str = "1997-06-20",
                           days: int = 30, limit: int = 100) -> DataFrame:
    """Net sales less refunds 30 days before/after ``day`` by supplier nation and category.

    Refunds come from returned lines (flag 'R'), left-joined on the two-column
    line key, so unreturned lines count in full.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
               "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    o = days_around(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"),
                    "o_orderdate", day, days, days)
    # only refunds of the window's orders
    refunds = (li.where(F.col("l_returnflag") == "R")
                 .join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
                 .select(F.col("l_orderkey").alias("r_orderkey"),
                         F.col("l_linenumber").alias("r_linenumber"),
                         net_paid().alias("refund")))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    p = table(spark, sf_dir, "part", "p_partkey", "p_type")
    x = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(refunds, (F.col("l_orderkey") == F.col("r_orderkey"))
                 & (F.col("l_linenumber") == F.col("r_linenumber")), "left")
           .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(p, F.col("l_partkey") == F.col("p_partkey")))
    value = net_paid() - F.coalesce(F.col("refund"), F.lit(0))
    before = F.col("o_orderdate").cast("date") < F.lit(day).cast("date")
    g = agg_conditional(x, ["n_name", "p_type"], {"sales_before": (before, value),
                                                  "sales_after": (~before, value)}, zero=True)
    g = g.select(F.col("n_name").alias("w_state"), F.col("p_type").alias("i_item_id"),
                 F.col("sales_before").cast("double").alias("sales_before"),
                 F.col("sales_after").cast("double").alias("sales_after"))
    return top_k(g, ["w_state", "i_item_id"], limit)


def q17_promo_ratio(spark: SparkSession, sf_dir: str, year: int = 1997, month: int = 12,
                    min_discount: float = 0.05) -> DataFrame:
    """Promoted share of sales in one month (promoted = discount >= min_discount)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o = date_range_filter(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"),
                          "o_orderdate", *month_range(year, month, month))
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    promoted = money("l_discount") >= F.lit(min_discount).cast("decimal(15,2)")
    g = agg_conditional(x, [], {"promotions": (promoted, net_paid()),
                                "total": (F.lit(True), net_paid())})
    return g.select(F.col("promotions").cast("double").alias("promotions"),
                    F.col("total").cast("double").alias("total"),
                    (F.col("promotions").cast("double") / F.col("total").cast("double")
                     * F.lit(100.0)).alias("promo_percent"))


def q21_return_rebuy(spark: SparkSession, sf_dir: str, year: int = 1996, month: int = 1,
                     limit: int = 100) -> DataFrame:
    """Parts sold in (year, month), returned within the next six months of
    that year, and bought again by the same customer on the web ('O') within
    three years: quantities per part and supplier."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    month_orders = date_range_filter(o, "o_orderdate", *month_range(year, month, month))
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    sold = li.join(month_orders, li.l_orderkey == month_orders.o_orderkey).select(
        F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("item"),
        F.col("o_custkey").alias("cust"), F.col("l_suppkey").alias("store"), F.col("l_quantity").alias("ss_qty"))
    # a return has the ticket, and with it the customer, of its sale
    back = date_range_filter(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
                                   "l_shipdate"), "l_shipdate", *month_range(year, month, min(month + 6, 12)))
    back = back.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("sr_qty"))
    returned = sold.join(back, ["ticket", "item"])
    later = date_range_filter(o, "o_orderdate", f"{year}-01-01", f"{year + 2}-12-31").select("o_orderkey", "o_custkey")
    web = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linestatus").where(
        F.col("l_linestatus") == "O")
    rebuy = (web.join(returned.select("item").distinct(), F.col("l_partkey") == F.col("item"), "left_semi")
                .join(later, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("l_partkey").alias("item"), F.col("o_custkey").alias("cust"),
                        F.col("l_quantity").alias("ws_qty")))
    j = returned.join(rebuy, ["item", "cust"])
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    j = j.join(p, j.item == p.p_partkey).join(s, j.store == s.s_suppkey)
    g = j.groupBy("p_partkey", "p_name", "s_suppkey", "s_name").agg(
        F.sum("ss_qty").cast("long").alias("store_sales_quantity"),
        F.sum("sr_qty").cast("long").alias("store_returns_quantity"),
        F.sum("ws_qty").cast("long").alias("web_sales_quantity"))
    return top_k(g, ["p_partkey", "p_name", "s_suppkey", "s_name"], limit)


def q22_inventory_change(spark: SparkSession, sf_dir: str, day: str = "1997-09-05",
                         days: int = 30, price_min=None, price_max=None,
                         limit: int = 100) -> DataFrame:
    """Shipped quantity 30 days before/after ``day`` per supplier and
    category, kept when after/before is within 2/3 .. 3/2."""
    li = days_around(table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity",
                           "l_shipdate"), "l_shipdate", day, days, days)
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_retailprice")
    if price_min is not None:
        p = p.where(F.col("p_retailprice").between(price_min, price_max))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    before = F.col("l_shipdate").cast("date") < F.lit(day).cast("date")
    g = agg_conditional(x, ["s_name", "p_type"], {"inv_before": (before, F.col("l_quantity")),
                                                  "inv_after": (~before, F.col("l_quantity"))},
                        zero=True)
    r = F.col("inv_after") / F.col("inv_before")
    g = g.where((F.col("inv_before") > 0) & (r >= F.lit(2.0) / F.lit(3.0))
                & (r <= F.lit(3.0) / F.lit(2.0)))
    g = g.select(F.col("s_name").alias("w_warehouse_name"), F.col("p_type").alias("i_item_id"),
                 F.col("inv_before").cast("long").alias("inv_before"),
                 F.col("inv_after").cast("long").alias("inv_after"))
    return top_k(g, ["w_warehouse_name", "i_item_id"], limit)
