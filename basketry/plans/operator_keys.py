"""
the whole driver tables (or data Spark derives from them and writes to the
shared checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import date_dim_for, days_of_weeks, virtual_ts
from basketry.operators import aggregates as A
from basketry.operators import basket as B
from basketry.operators import filters as FL
from basketry.operators import fold as FO
from basketry.operators import joins as J
from basketry.operators import ml as ML
from basketry.operators import runs as R
from basketry.operators import sessions as S
from basketry.operators import text as TX
from basketry.plans.common import DAY_S, s_to_us
from basketry.session import scratch_path
from basketry.sources import delimited as D
from basketry.sources import logs as L
from basketry.sources import nested as N
from basketry.streaming import numbered as NS
from basketry.sources.tables import (clicks, epoch_seconds, money, net_paid, scan_columnar,
                                     table)

ROWS_ONLY = ("limit_any", "logreg_interest", "kmeans_segments",
             "nb_text_classifier")

# Fixed values of the derived run logs: the five engine/config sets of the
# reference's comparison and its two timed phases.
ENGINES = ["homr", "hos", "hos_gen", "hot", "sparksql"]
PHASES = ["POWER_TEST", "THROUGHPUT_TEST"]


# --- 2.1 scans, sources, sinks ------------------------------------------------

def scan_columnar_key(spark, d):
    li = scan_columnar(spark, d, "lineitem",
                       columns=["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])
    return li.where(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit("1998-01-01")))


def load_delimited(spark, d):
    """lineitem as `|` text, loaded with its declared schema into Parquet."""
    li = table(spark, d, "lineitem")
    text = D.write_delimited(li, scratch_path(spark, "lineitem-text"), sep="|")
    typed = D.load_delimited(spark, text, li.schema, sep="|")
    return spark.read.parquet(D.to_columnar(typed, scratch_path(spark, "lineitem-columnar")))


def sink_result_text(spark, d):
    c = table(spark, d, "customer", "c_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    res = (c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name")
            .agg(F.count(F.lit(1)).alias("cnt")))
    path = D.sink_result_text(res, scratch_path(spark, "result-text"))
    return spark.read.schema("n_name string, cnt long").csv(path)


def append_refresh(spark, d):
    """Orders up to 1998 and a refresh set of the later ones; the refresh fails
    once before it is published, and is repeated twice."""
    o = table(spark, d, "orders")
    cut = F.to_timestamp_ntz(F.lit("1999-01-01"))
    base = F.coalesce(F.col("o_orderdate") < cut, F.lit(False))  # an order without a date is refresh
    path = scratch_path(spark, "orders-refresh")
    D.refresh_table(o.where(base), path, "base")
    D.stage_refresh(o.where(~base), path)  # left half-done
    for _ in range(2):
        D.refresh_table(o.where(~base), path, "refresh-1")
    return D.read_refreshed(spark, path).drop("refresh")


def load_checked(spark, d):
    """Rejects of a text load: lineitem as text in which some lines have a quantity
    that is no number, lack their last fields, or have one too many."""
    li = table(spark, d, "lineitem")
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(D.HIVE_NULL)) for c in li.columns])
    k = F.col("l_orderkey") % 50
    bad = F.when(k == 1, F.regexp_replace(line, "^(\\d+\\|\\d+\\|\\d+\\|\\d+\\|)[^|]*", "$1many")).when(
        k == 2, F.substring_index(line, "|", 9)).when(k == 3, F.concat(line, F.lit("|x|y"))).otherwise(line)
    path = scratch_path(spark, "lineitem-faults")
    li.select(bad.alias("value")).write.text(path)
    loaded = D.ctas_temp(spark, D.load_checked(spark, path, li.schema), "lineitem-checked")
    faults = D.rejected_fields(loaded).groupBy("column", "reason", "value").agg(F.count(F.lit(1)).alias("lines"))
    whole = loaded.where("_line IS NULL").agg(F.count(F.lit(1)).alias("lines")).select(
        F.lit(None).cast("string").alias("column"), F.lit("loaded whole").alias("reason"), F.lit(None).cast("string").alias("value"), "lines")
    return faults.unionByName(whole)


def multi_insert(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    lab = table(spark, d, "labels", "doc_id", "quality")
    x = docs.join(lab, "doc_id")
    test = F.pmod(F.col("doc_id"), F.lit(10)) == 0
    tagged = D.multi_insert(x, {"train": ~test, "test": test})
    path = scratch_path(spark, "review-split")
    tagged.write.mode("overwrite").partitionBy("target").parquet(path)
    return spark.read.parquet(path).select("doc_id", "quality", "target")


def ctas_temp(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    yearly = (li.join(o, li.l_orderkey == o.o_orderkey)
                .groupBy("o_custkey", F.year("o_orderdate").alias("yr"))
                .agg(F.sum(net_paid()).alias("total")))
    t = D.ctas_temp(spark, yearly, "customer-yearly")
    a, b = t.alias("a"), t.alias("b")
    return (a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey"))
                   & (F.col("b.yr") == F.col("a.yr") + 1))
             .select(F.col("a.o_custkey").alias("cust"), F.col("a.yr").alias("yr"),
                     F.col("a.total").cast("double").alias("total"),
                     F.col("b.total").cast("double").alias("next_total")))


def _runlog_text(spark, d) -> str:
    """A run log derived from the click table (one run per click): engine by
    user, duration = value seconds, query = item mod 30 + 1, phase by hour,
    status FAILED for error clicks. Written as `|` text with a heading."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = e.select(
        F.element_at(F.array(*[F.lit(x) for x in ENGINES]),
                     (F.pmod(F.col("user_id"), F.lit(len(ENGINES))) + 1).cast("int")).alias("engine"),
        F.col("user_id").cast("string").alias("run"),
        F.round(F.col("value") * 1000).cast("long").cast("string").alias("duration"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.col("event_id").cast("string").alias("id"),
        F.lit("").alias("f5"),
        (F.pmod(k, F.lit(30)) + 1).cast("string").alias("query"),
        F.lit("").alias("f7"),
        F.when(F.hour("ts") < 12, PHASES[0]).otherwise(PHASES[1]).alias("phase"),
        F.lit("").alias("f9"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"))
    return D.write_delimited(rows, scratch_path(spark, "runlog"), sep="|", header=True)


def scan_runlog(spark, d):
    return L.scan_runlog(spark, _runlog_text(spark, d))


def scan_querylog(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("long")
    outcome = F.when(F.col("event_type") == "error",
                     F.concat(F.lit(L.FAILURE_PREFIX), F.lit("SemanticException in run "),
                              F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("Time taken: "), F.col("value").cast("string"), F.lit(" seconds, Fetched: "),
                 F.col("user_id").cast("string"), F.lit(" row(s)")))
    noise = F.concat(F.lit("Query ID = run_"), F.col("event_id").cast("string"))
    lines = e.select((F.pmod(k, F.lit(30)) + 1).alias("query"),
                     F.explode(F.array(noise, outcome)).alias("value"))
    path = scratch_path(spark, "querylog")
    lines.write.mode("overwrite").partitionBy("query").text(path)
    return L.scan_querylog(spark, path)


def runs_minutes(spark, d):
    return R.runs_minutes(scan_runlog(spark, d)).select("query", "phase", "duration_ms", "minutes")


def runs_average(spark, d):
    return R.runs_average(scan_runlog(spark, d))


def runs_compare(spark, d):
    runs = scan_runlog(spark, d)
    first_half = F.coalesce(F.col("start") < F.lit("2024-01-16"), F.lit(False))
    return R.runs_compare(runs.where(first_half), runs.where(~first_half))


def runs_failures(spark, d):
    return R.runs_failures(scan_runlog(spark, d))


def runs_engines(spark, d):
    path = _runlog_text(spark, d)
    raw = (spark.read.schema(", ".join(f"c{i} string" for i in range(L.RUNLOG_WIDTH)))
           .option("sep", "|").option("header", True).option("quote", "\u0000").csv(path))
    runs = raw.select(F.col("c0").alias("engine"),
                      F.col("c6").try_cast("int").alias("query"),
                      F.col("c2").try_cast("long").alias("duration_ms"),
                      F.coalesce(F.col("c10") == "FAILED", F.lit(False)).alias("failed"))
    return R.runs_engines(runs, ENGINES)


def result_diff(spark, d):
    """A text round trip of lineitem that lost the orders divisible by 97 and
    doubled those by 89, against the Parquet table."""
    key = F.col("l_orderkey")
    got = load_delimited(spark, d).where(key % 97 != 0)
    got = got.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(key % 89 == 0, 2).otherwise(1)))).drop("_n")
    return R.result_diff(got, table(spark, d, "lineitem"))


def _nested_from_orders(spark, d):
    return N.gen_nested(table(spark, d, "orders", "o_orderkey"), "o_orderkey", seed=0)


def gen_nested(spark, d):
    """Every field of the nested rows; an array as its items joined by commas."""
    a = _nested_from_orders(spark, d).select("a.*")
    return a.select(*[F.array_join(f.name, ",").alias(f.name) if f.dataType.typeName() == "array" else f.name
                      for f in a.schema.fields])


def _nested_text_path(spark, d):
    path = scratch_path(spark, "nested-text")
    N.nested_to_text(_nested_from_orders(spark, d)).write.mode("overwrite").text(path)
    return path


NESTED_LEAVES = [1, 9, 14, 18, 24]


def load_nested_text(spark, d):
    n = N.load_nested_text(spark, _nested_text_path(spark, d))
    return N.nested_project(n, NESTED_LEAVES, limit=None)


def nested_to_columnar(spark, d):
    n = N.load_nested_text(spark, _nested_text_path(spark, d))
    path = N.nested_to_columnar(n, scratch_path(spark, "nested-parquet"))
    return spark.read.parquet(path).select(F.col("a.a1").alias("a1"),
                                           F.size("a.a5").alias("a5_items"),
                                           F.col("a.a30").alias("a30"))


def nested_project(spark, d):
    n = N.load_nested_text(spark, _nested_text_path(spark, d))
    path = N.nested_to_columnar(n, scratch_path(spark, "nested-parquet"))
    return N.nested_project(spark.read.parquet(path), NESTED_LEAVES, limit=None)


def limit_any(spark, d):
    return N.nested_project(_nested_from_orders(spark, d), [1, 5, 10, 15, 20], limit=100)


# --- 2.2 projections, filters -------------------------------------------------

def project_expr(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice",
               "l_discount", "l_tax")
    ext, disc, tax = money("l_extendedprice"), money("l_discount"), money("l_tax")
    profit = ((ext - ext * tax - ext * disc) + net_paid()) * F.lit(0.5).cast("decimal(2,1)")
    return li.select("l_orderkey", "l_linenumber", profit.cast("decimal(20,5)").alias("profit"))


def filter_in_list(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    return FL.filter_in_list(li, "l_suppkey", [3, 7, 11, 19, 42])


def filter_between(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return FL.filter_between(li, "l_quantity", 10, 20)


def filter_disjunctive(spark, d):
    from basketry.plans.sales import Q09_NATION_BANDS, Q09_SEGMENT_BANDS
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    x = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
           .withColumn("_net", net_paid()))
    x = FL.filter_disjunctive(x, [[("c_mktsegment", "=", s), ("l_extendedprice", "between", (lo, hi))]
                                  for s, lo, hi in Q09_SEGMENT_BANDS])
    x = FL.filter_disjunctive(x, [[("c_nationkey", "in", ns), ("_net", "between", (lo, hi))]
                                  for ns, lo, hi in Q09_NATION_BANDS])
    return x.select("l_orderkey", "l_linenumber")


def filter_not_null(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "props")
    return FL.filter_not_null(e, "user_id", "props").select("event_id")


def filter_is_null(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    e = e.withColumn("sale_id", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return FL.filter_is_null(e, "sale_id").select("event_id", "event_type")


def date_range_filter(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return FL.date_range_filter(o, "o_orderdate", "1996-01-01", "1996-03-31")


def days_around(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    return FL.days_around(li, "l_shipdate", "1997-06-20", 30, 30)


def in_subquery(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    urgent = table(spark, d, "orders", "o_orderkey", "o_orderpriority").where(
        F.col("o_orderpriority") == "1-URGENT")
    return FL.in_subquery(li, "l_orderkey", urgent, "o_orderkey")


# --- 2.3 joins ----------------------------------------------------------------

def join_inner(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("l_orderkey", "l_linenumber", "c_custkey", "n_name", "r_name"))


def join_left(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice",
               "l_discount", "l_returnflag")
    ret = li.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("r_ok"), F.col("l_linenumber").alias("r_ln"),
        net_paid().alias("refund"))
    j = li.join(ret, (F.col("l_orderkey") == F.col("r_ok")) & (F.col("l_linenumber") == F.col("r_ln")),
                "left")
    return j.select("l_orderkey", "l_linenumber",
                    F.coalesce(F.col("refund"), F.lit(0)).cast("double").alias("refund"))


def join_left_semi(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    o = FL.date_range_filter(table(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate",
                             "1996-01-01", "1996-12-31")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi")


def join_multi_key(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    x = li.join(FL.date_range_filter(o, "o_orderdate", "1996-01-01", "1996-12-31"), li.l_orderkey == o.o_orderkey)
    # a line returned with its ticket, item and customer is a line of that order
    sold = x.select(
        F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("item"),
        F.col("o_custkey").alias("cust"), F.col("l_quantity").alias("ss_qty"))
    ret = x.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("item"),
        F.col("o_custkey").alias("cust"), F.col("l_quantity").alias("sr_qty"))
    return sold.join(ret, ["ticket", "item", "cust"])


# Three days inside the test tables' ship dates, one a Monday, one a Sunday.
JOIN_SELF_DATES = ["1996-04-15", "1997-09-28", "1999-02-03"]


def join_self(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    days = days_of_weeks(spark, JOIN_SELF_DATES)
    return (li.join(days, F.col("l_shipdate").cast("date") == F.col("day"), "left_semi"))


def _growth_frames(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_linestatus")
    o = FL.date_range_filter(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate",
                             "1996-01-01", "1997-12-31")
    yr = F.year("o_orderdate")
    # one pass over the facts, grouped by channel; both sides read its result
    per = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_linestatus").agg(
        F.sum(F.when(yr == 1996, net_paid()).otherwise(0)).alias("f"),
        F.sum(F.when(yr == 1997, net_paid()).otherwise(0)).alias("s")))
    per = D.ctas_temp(spark, per, "channel-growth").where(F.col("f") > 0)

    def side(ch):
        return per.where(F.col("l_linestatus") == ch).select(
            "o_custkey", (F.col("s").cast("double") / F.col("f").cast("double")).alias("ratio"))
    return side("F"), side("O")


def join_nonequi_residual(spark, d):
    st, wb = _growth_frames(spark, d)
    st = st.withColumnRenamed("ratio", "store_ratio")
    wb = wb.withColumnRenamed("ratio", "web_ratio")
    j = J.join_nonequi_residual(st, wb, ["o_custkey"], F.col("web_ratio") > F.col("store_ratio"))
    return j.select(st.o_custkey.alias("cust"),
                    F.col("store_ratio").cast("decimal(15,4)").alias("store_ratio"),
                    F.col("web_ratio").cast("decimal(15,4)").alias("web_ratio"))


def join_tolerance(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    r = li.where(F.col("l_returnflag") == "R")
    sr = r.where(F.col("l_linestatus") == "F").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("sr_item_qty"))
    wr = r.where(F.col("l_linestatus") == "O").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("wr_item_qty"))
    return J.join_tolerance(sr, wr, ["l_partkey"], "sr_item_qty", "wr_item_qty", 0.1)


def join_scalar(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_quantity")
    # per flag once; both one-row aggregates read those few rows
    flags = D.ctas_temp(spark, li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")), "per-flag")
    a = flags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_lines"))
    b = flags.where(F.col("l_returnflag") == "R").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("returned_lines"), F.sum("q").cast("long").alias("returned_quantity"))
    return J.join_scalar(a, b)


def join_contains(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    names = table(spark, d, "benchmark", "item_id", "text").select(
        "item_id", F.lower("text").alias("matched_name"))
    hits = J.join_contains(docs, "doc_id", "text", names, "matched_name", carry=["item_id"])
    return hits.select("doc_id", "item_id")


def join_interval_before_after(spark, d):
    from basketry.plans.stats import market_prices, sales_near
    changes = market_prices(table(spark, d, "part", "p_partkey")).withColumnRenamed("p_partkey", "item")
    ba = J.before_after(sales_near(spark, d, changes), changes, "item", "sold", "qty", "imp_start_date",
                        "no_days_comp_price", keys=["imp_sk"], split=F.col("ch"))
    return ba.select("item", "imp_sk", "after_F", "before_F", "after_O", "before_O")


def join_dimension_broadcast(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name")   # fixed-size: broadcast hint
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
              .groupBy("n_name").agg(F.count(F.lit(1)).alias("lines")))


# --- 2.4 aggregates -------------------------------------------------------------

def agg_basic(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity",
               "l_extendedprice", "l_discount")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("count_order"),
        F.sum("l_quantity").cast("long").alias("sum_qty"),
        F.sum(money("l_extendedprice")).cast("double").alias("sum_price"),
        (F.sum(money("l_extendedprice")).cast("double") / F.count("l_extendedprice")).alias("avg_price"),
        F.max("l_discount").alias("max_disc"))


def agg_global(spark, d):
    li = table(spark, d, "lineitem", "l_extendedprice", "l_discount", "l_shipdate")
    return li.agg(F.count(F.lit(1)).alias("lines"),
                  F.sum(net_paid()).cast("double").alias("net"),
                  F.max("l_shipdate").alias("last_ship"))


YEARS = list(range(1995, 2002))


def agg_conditional(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    x = (li.join(o, li.l_orderkey == o.o_orderkey).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
           .select("s_nationkey", F.year("o_orderdate").alias("yr"), net_paid().alias("net")))
    p = x.groupBy("s_nationkey").pivot("yr", YEARS).agg(F.sum("net"))
    return p.select("s_nationkey", *[F.col(str(y)).cast("double").alias(f"y{y}") for y in YEARS])


def agg_count_distinct(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    return A.agg_count_distinct(x, ["o_custkey"], "l_orderkey", "orders")


def agg_having(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity")
    g = li.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("qty"),
                                    F.count(F.lit(1)).alias("cnt"))
    return A.agg_having(g, F.col("cnt") > 600)


def agg_stddev_cov(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity")
    g = A.agg_stddev_cov(li, ["l_suppkey"], "l_quantity")
    return g.select("l_suppkey", F.col("stdev").cast("decimal(15,5)").alias("stdev"),
                    F.col("mean").cast("decimal(15,5)").alias("mean"),
                    F.col("cov").cast("decimal(15,5)").alias("cov"))


def agg_corr(spark, d):
    li = table(spark, d, "lineitem", "l_linestatus", "l_quantity", "l_extendedprice")
    g = A.agg_corr(li, "l_quantity", "l_extendedprice", by=["l_linestatus"])
    return g.select("l_linestatus", F.round("corr", 9).alias("corr"))


def agg_linreg(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = FL.date_range_filter(table(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate",
                             "1997-01-01", "1997-12-31")
    daily = (li.join(o, li.l_orderkey == o.o_orderkey)
               .groupBy(F.col("l_suppkey").alias("store"),
                        F.datediff(F.col("o_orderdate").cast("date"),
                                   F.lit("1997-01-01").cast("date")).alias("x"))
               .agg(F.sum(net_paid()).cast("double").alias("y")))
    reg = A.agg_linreg(daily, ["store"], "x", "y")
    return reg.select("store", F.round("slope", 6).alias("slope"),
                      F.round("intercept", 4).alias("intercept"))


def agg_ratio_of_totals(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    x = li.join(s, li.l_suppkey == s.s_suppkey).withColumn("net", net_paid())
    g = A.agg_ratio_of_totals(x, F.col("l_returnflag") == "R", "net", by=["s_nationkey"])
    return g.select("s_nationkey", F.col("part").cast("double").alias("part"),
                    F.col("whole").cast("double").alias("whole"), "percent")


def agg_two_level(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    daily = li.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum(net_paid()).alias("day_net"))
    return daily.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("days"),
        (F.sum("day_net").cast("double") / F.count(F.lit(1))).alias("avg_day_net"),
        F.max("day_net").cast("double").alias("max_day_net"))


def agg_collect_set(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, d, "part", "p_partkey", "p_type")
    x = li.join(p, li.l_partkey == p.p_partkey)
    g = A.agg_collect_set(x, ["l_orderkey"], "p_type", "types")
    return g.select("l_orderkey", F.size("types").alias("n_types"),
                    F.array_join("types", ",").alias("types"))


def agg_collect_list(spark, d):
    """Every user's click path, in order, as lists of at most 50 pages."""
    c = clicks(spark, d).where(F.col("ts_us").isNotNull())
    c = c.select("user_id", "ts_us", "event_id", F.coalesce("event_type", F.lit("-")).alias("page"))
    paths = S.collect_ordered(c, ["user_id"], ["ts_us", "event_id"], "page", chunk=50, out="pages")
    return paths.select("user_id", "chunk_no", F.array_join("pages", ">").alias("path"))


def distinct_rows(spark, d):
    return table(spark, d, "events", "user_id", "event_type").distinct()


# --- 2.5 ordered-per-key ----------------------------------------------------------

def distribute_sort(spark, d):
    c = clicks(spark, d).select("user_id", "ts_us", "event_id")
    return S.distribute_sort(c, ["user_id"], ["ts_us", "event_id"])


def sessionize(spark, d):
    c = clicks(spark, d).select("event_id", "user_id", "ts_us")
    return S.sessionize(c, "user_id", "ts_us", s_to_us(3600)).select(
        "event_id", "user_id", "session_id")


def last_n_before(spark, d):
    c = clicks(spark, d)
    return S.last_n_before(c, "user_id", "ts_us", "item", F.col("event_type") == "view",
                           F.col("event_type") == "purchase", max_age=s_to_us(10 * DAY_S), n=5,
                           tiebreak="event_id")


def purchase_after_page(spark, d):
    c = clicks(spark, d).withColumn(
        "sale_id", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return S.purchase_after_page(c, "user_id", "ts_us", "event_type", "sale_id", wanted="view",
                                 within=s_to_us(3 * DAY_S), tiebreak="event_id")


def abandoned_sessions(spark, d):
    c = clicks(spark, d)
    s = S.sessionize(c, "user_id", "ts_us", s_to_us(6 * 3600))
    return S.abandoned_sessions(s, "session_id", "ts_us", "event_type", "click", "purchase")


def reduce_using_script(spark, d):
    """Sessions and abandoned carts by one ordered reducer over each user's clicks."""
    c = clicks(spark, d).select("user_id", "ts_us", "event_id", *[
        F.when(F.col("event_type") == kind, F.col("ts_us")).alias(name)
        for name, kind in (("cart", "click"), ("checkout", "purchase"))])
    machine = FO.Sessions("ts_us", "cart", "checkout", s_to_us(6 * 3600))
    s = FO.segmented_fold(c, ["user_id"], ["ts_us", "event_id"], machine, ["ts_us", "cart", "checkout"])
    s = s.where(F.col("last_cart").isNotNull() & F.coalesce(F.col("last_checkout") < F.col("last_cart"), F.lit(True)))
    return s.select(F.concat_ws("_", "user_id", "session_no").alias("session_id"), F.col("pages").alias("pagecount"))


def reduce_page_before_sale(spark, d):
    """Sales after a page view of the last days, by an ordered reducer."""
    c = clicks(spark, d).select("user_id", "ts_us", "event_id",
                                F.when(F.col("event_type") == "view", F.col("ts_us")).alias("seen"),
                                F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("sale"))
    machine = FO.SeenBefore("ts_us", "seen", "sale", s_to_us(3 * DAY_S))
    return FO.segmented_fold(c, ["user_id"], ["ts_us", "event_id"], machine, ["ts_us", "seen", "sale"]).select("sale_id")


def reduce_last_views(spark, d):
    """Last views before each purchase, by an ordered reducer."""
    c = clicks(spark, d).select("user_id", "ts_us", "event_id", *[
        F.when(F.col("event_type") == kind, F.col("item")).alias(kind) for kind in ("view", "purchase")])
    machine = FO.LastSeen("ts_us", "view", "purchase", s_to_us(10 * DAY_S), 5)
    return FO.segmented_fold(c, ["user_id"], ["ts_us", "event_id"], machine, ["ts_us", "view", "purchase"]).select(
        "purchased_item", "lastviewed_item")


def stream_sessions(spark, d):
    """Numbered sessions of the click stream. The clicks arrive in five slices of
    time; of every slice a tenth of the last half day comes late, with the next.
    The query is stopped after each slice and goes on from its checkpoint; a
    closing click far in the future ends the open sessions."""
    e = table(spark, d, "events").where(F.col("ts").isNotNull() & F.col("user_id").isNotNull())
    t = epoch_seconds("ts")
    lo, hi = e.agg(F.min(t), F.max(t)).first()
    path = scratch_path(spark, "stream")
    if lo is None:
        return spark.createDataFrame([], NS.OUT)
    width = (hi - lo) // 5 + 1
    at = F.floor((t - F.lit(lo)) / F.lit(width))
    late = (F.floor((t - F.lit(lo) + 12 * 3600) / F.lit(width)) > at) & (F.pmod("event_id", F.lit(10)) == 0)
    sliced = D.ctas_temp(spark, e.withColumn("_s", at + F.when(late, 1).otherwise(0)), "slices")
    for k in range(7):
        part = sliced.where(F.col("_s") == k).drop("_s")
        if k == 6:
            part = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"),
                                         F.lit(-1).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
                                         F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        part.write.mode("append").parquet(f"{path}/in")
        NS.run_numbered(spark, f"{path}/in", f"{path}/out", f"{path}/ckpt", s_to_us(3600), "1 day", e.schema)
    return spark.read.parquet(f"{path}/out").where("user_id <> -1")


def recency_flag(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("last_day"))
    return S.recency_flag(last, "last_day", "2001-08-01", 60).select("o_custkey", "recency")


# --- 2.6 order, limit -------------------------------------------------------------

def order_global(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.orderBy("o_orderdate", "o_orderkey")


def top_k(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return B.top_k(li, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 100)


# --- 2.7 set operations -----------------------------------------------------------

def union_all_channels(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_linestatus")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    # one pass over the facts; the channels of the union stay apart as groups
    x = li.where(F.col("l_linestatus").isin("F", "O")).join(o, li.l_orderkey == o.o_orderkey)
    per = x.groupBy("o_custkey", "l_linestatus").agg(
        F.countDistinct("l_orderkey").alias("frequency"), F.sum(net_paid()).cast("double").alias("amount"))
    name = F.when(F.col("l_linestatus") == "F", "store").otherwise("web")
    return per.select("o_custkey", "frequency", "amount", name.alias("channel"))


# --- 2.8 scalar, array, text functions ------------------------------------------------

def fn_case_coalesce(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_returnflag") == "R", "returned")
                      .when(F.col("l_returnflag") == "A", "accepted").otherwise("none").alias("state"),
                     F.coalesce(F.when(F.col("l_discount") > 0.05, F.col("l_discount")),
                                F.lit(0.0)).alias("big_discount"))


def fn_math(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber",
                     F.abs(F.col("l_quantity") - 25).alias("qty_dev"),
                     F.round(F.col("l_extendedprice") / F.col("l_quantity"), 7).alias("unit_price"),
                     F.pmod(F.col("l_orderkey"), F.lit(10)).alias("bucket"))


def fn_cast(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber",
                     F.col("l_quantity").cast("long").alias("qty"),
                     F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
                     F.col("l_linenumber").cast("double").alias("line_d"))


def fn_date(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", day.alias("day"), F.year(day).alias("yr"),
                    F.month(day).alias("mon"),
                    F.datediff(day, F.lit("1995-01-01").cast("date")).alias("day_no"),
                    epoch_seconds("o_orderdate").alias("epoch_s"))


def fn_virtual_ts(spark, d):
    e = table(spark, d, "events", "event_id", "ts")
    day_key = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    sec_key = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    return e.select("event_id", virtual_ts(day_key, sec_key).alias("ts_s"))


def fn_string(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey",
                    F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("label"),
                    F.lower("p_brand").alias("brand_lc"),
                    F.locate("o", F.col("p_name")).alias("first_o"))


def fn_array(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name")
    words = F.sort_array(F.split(F.col("p_name"), " "))
    x = p.select("p_partkey", words.alias("w"))
    return x.select("p_partkey", F.array_contains("w", "ring").alias("has_ring"),
                    F.size("w").alias("n_words"), F.explode("w").alias("word"))


def build_date_dim_key(spark, d):
    o = table(spark, d, "orders", "o_orderdate")
    return date_dim_for(o, "o_orderdate")


# --- 2.10 UDTF / ML surface --------------------------------------------------------

def make_pairs(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, d, "part", "p_partkey", "p_type")
    x = li.join(p, li.l_partkey == p.p_partkey)
    return B.make_pairs(x, "l_orderkey", "p_type")


def pair_counts_parts(spark, d):
    """Part pairs bought together more than once: an unbounded item domain."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    return B.pair_counts(li, "l_orderkey", "l_partkey", min_count=1)


def viewed_with_item(spark, d):
    c = clicks(spark, d).where(F.col("item").isNotNull())
    s = S.sessionize(c, "user_id", "ts_us", s_to_us(DAY_S))
    s = D.ctas_temp(spark, s.select("session_id", "item").distinct(), "session-items")
    return B.viewed_with_item(s, "session_id", "item", 10)


def extract_sentiment(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return TX.extract_sentiment(docs, ["doc_id"], "text", TX.lexicon_df(spark))


def extract_negative(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return TX.extract_sentiment(docs, ["doc_id", "source"], "text", TX.lexicon_df(spark), only="NEG")


def find_company(spark, d):
    from basketry.plans.text_jobs import company_names
    docs = table(spark, d, "documents", "doc_id", "text")
    return TX.find_company(docs, ["doc_id"], "text",
                           company_names(spark, d))


def _places(spark, d):
    """A dictionary of names of one to three words: the beginnings of the benchmark
    texts; the same name may stand for several items."""
    b = table(spark, d, "benchmark", "item_id", "text")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0)), 1,
                    (F.pmod(F.col("item_id"), F.lit(3)) + 1).cast("int"))
    return b.select(F.array_join(words, " ").alias("name")).where(F.length("name") >= 4).distinct()


def find_company_names(spark, d):
    """Names of several words: the longest from the left, whole words."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return TX.find_company(docs, ["doc_id"], "text", _places(spark, d))


def _labelled(spark, d):
    """Reviews with the label ``toxic`` as class; a fifth of the labels is held out."""
    lab = table(spark, d, "labels", "doc_id", "toxic")
    lab = lab.where(F.pmod("doc_id", F.lit(5)) != 0).select("doc_id", (F.col("toxic") == 1).alias("negative"))
    return table(spark, d, "documents", "doc_id", "text").join(lab, "doc_id", "left")


def learn_lexicon(spark, d):
    """Polar words learned from labels, with a prior from the whole corpus."""
    return TX.learn_lexicon(_labelled(spark, d), "text", "negative")


def extract_polarity(spark, d):
    """Polar words of the learned lexicon in every sentence, negation resolved."""
    lex = D.ctas_temp(spark, learn_lexicon(spark, d).select("word", "sentiment"), "lexicon")
    docs = table(spark, d, "documents", "doc_id", "text")
    return TX.extract_polarity(docs, ["doc_id"], "text", lex)


def logreg_interest(spark, d):
    """Returned or not, from a line's quantity, discount, tax and price."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    li = li.withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    return ML.logreg_interest(li, "label", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_orderkey")


def kmeans_segments(spark, d):
    """Segments of parts by lines sold, quantity and mean discount."""
    g = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_discount").groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"))
    return ML.kmeans_segments(g, "l_partkey", ["lines", "quantity", "discount"], k=5)


def nb_text_classifier(spark, d):
    """Toxic or not, from the words of a review."""
    from basketry.plans.ml_jobs import review_predictions
    return review_predictions(spark, d, "toxic")


KEYS = {
    "scan_columnar": scan_columnar_key, "load_delimited": load_delimited,
    "load_nested_text": load_nested_text, "nested_to_columnar": nested_to_columnar,
    "gen_nested": gen_nested, "append_refresh": append_refresh,
    "sink_result_text": sink_result_text, "multi_insert": multi_insert, "ctas_temp": ctas_temp,
    "scan_runlog": scan_runlog, "scan_querylog": scan_querylog,
    "project_expr": project_expr, "nested_project": nested_project,
    "filter_in_list": filter_in_list, "filter_between": filter_between,
    "filter_disjunctive": filter_disjunctive, "filter_not_null": filter_not_null,
    "filter_is_null": filter_is_null, "date_range_filter": date_range_filter,
    "days_around": days_around, "in_subquery": in_subquery,
    "join_inner": join_inner, "join_left": join_left, "join_left_semi": join_left_semi,
    "join_multi_key": join_multi_key, "join_self": join_self,
    "join_nonequi_residual": join_nonequi_residual, "join_tolerance": join_tolerance,
    "join_scalar": join_scalar, "join_contains": join_contains,
    "join_interval_before_after": join_interval_before_after,
    "join_dimension_broadcast": join_dimension_broadcast,
    "agg_basic": agg_basic, "agg_global": agg_global, "agg_conditional": agg_conditional,
    "agg_count_distinct": agg_count_distinct, "agg_having": agg_having,
    "agg_stddev_cov": agg_stddev_cov, "agg_corr": agg_corr, "agg_linreg": agg_linreg,
    "agg_ratio_of_totals": agg_ratio_of_totals, "agg_two_level": agg_two_level,
    "agg_collect_set": agg_collect_set,
    "distinct_rows": distinct_rows, "agg_collect_list": agg_collect_list,
    "load_checked": load_checked, "stream_sessions": stream_sessions,
    "distribute_sort": distribute_sort, "sessionize": sessionize, "last_n_before": last_n_before,
    "purchase_after_page": purchase_after_page, "abandoned_sessions": abandoned_sessions,
    "recency_flag": recency_flag, "reduce_using_script": reduce_using_script,
    "reduce_page_before_sale": reduce_page_before_sale, "reduce_last_views": reduce_last_views,
    "order_global": order_global, "top_k": top_k, "limit_any": limit_any,
    "union_all_channels": union_all_channels, "result_diff": result_diff,
    "fn_case_coalesce": fn_case_coalesce, "fn_math": fn_math, "fn_cast": fn_cast,
    "fn_date": fn_date, "fn_virtual_ts": fn_virtual_ts, "fn_string": fn_string,
    "fn_array": fn_array, "build_date_dim": build_date_dim_key,
    "make_pairs": make_pairs, "pair_counts_parts": pair_counts_parts, "viewed_with_item": viewed_with_item,
    "extract_sentiment": extract_sentiment, "extract_negative": extract_negative,
    "find_company": find_company, "find_company_names": find_company_names,
    "learn_lexicon": learn_lexicon, "extract_polarity": extract_polarity,
    "logreg_interest": logreg_interest, "kmeans_segments": kmeans_segments,
    "nb_text_classifier": nb_text_classifier,
    "runs_minutes": runs_minutes, "runs_average": runs_average, "runs_compare": runs_compare,
    "runs_failures": runs_failures, "runs_engines": runs_engines,
}
