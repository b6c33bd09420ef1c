"""Feature tables and models (reference q05, q20, q25, q26, q28).

Feature tables are plain aggregates (oracle-checked); the models fitted on
them are rows-only checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.ml import classifier_accuracy, kmeans_segments, logreg_interest, nb_text_classifier
from basketry.operators.sessions import recency_flag
from basketry.sources.delimited import ctas_temp
from basketry.sources.tables import clicks, net_paid, table

ROWS_ONLY = ("q05_interest_model", "q20_return_segments", "q25_rfm_segments",
             "q26_book_clubs", "q28_review_classifier")

N_CATEGORIES = 10  # click item category = item div 10 (items 0..99)


def q05_interest_features(spark: SparkSession, sf_dir: str, category: int = 1,
                          college_segments=("BUILDING", "MACHINERY")) -> DataFrame:
    """Per user: clicks in the target category (label) and in every
    category, plus two customer flags (decision: segment stands for
    education, an even nation key for gender)."""
    c = clicks(spark, sf_dir).where(F.col("user_id").isNotNull() & F.col("item").isNotNull())
    cat = F.floor(F.col("item") / 10)
    aggs = [F.sum(F.when(cat == category, 1).otherwise(0)).alias("clicks_in_category")]
    aggs += [F.sum(F.when(cat == k, 1).otherwise(0)).alias(f"clicks_in_{k}")
             for k in range(N_CATEGORIES)]
    u = c.groupBy("user_id").agg(*aggs)
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return u.join(cust, u.user_id == cust.c_custkey).select(
        "user_id", "clicks_in_category",
        F.when(F.col("c_mktsegment").isin(list(college_segments)), 1).otherwise(0)
         .alias("college_education"),
        F.when(F.pmod(F.col("c_nationkey"), F.lit(2)) == 0, 1).otherwise(0).alias("male"),
        *[f"clicks_in_{k}" for k in range(N_CATEGORIES)])


def q05_interest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression: is a user's interest in the category above the
    mean? (decision: the source label is a count). One row of metrics on users
    held out. The category's own clicks are the label, so they are no feature."""
    category = 1
    f = ctas_temp(spark, q05_interest_features(spark, sf_dir, category), "q05-features")
    mean = f.agg(F.avg("clicks_in_category").alias("m")).select("m").scalar()
    f = f.withColumn("label", (F.col("clicks_in_category") > mean).cast("double"))
    cols = ["college_education", "male"] + [f"clicks_in_{k}" for k in range(N_CATEGORIES) if k != category]
    return logreg_interest(f, "label", cols, "user_id")


def return_ratios(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer: returned/ordered ratios of orders, lines and money
    (0.0 when undefined) and the number of orders with a return.

    ``lines``: l_orderkey, l_extendedprice, l_discount, l_returnflag;
    ``orders``: o_orderkey, o_custkey. Lines -> orders -> customers: the
    first level groups on the join key (no extra shuffle once the join is a
    shuffle join), the second shuffles one row per order.
    """
    ret = F.col("l_returnflag") == "R"
    per_order = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
                      .groupBy("o_custkey", "l_orderkey")
                      .agg(F.count(F.lit(1)).alias("lines"), F.sum(net_paid()).alias("money"),
                           F.count(F.when(ret, 1)).alias("r_lines"),
                           F.sum(F.when(ret, net_paid())).alias("r_money")))
    per_cust = per_order.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders_count"), F.sum("lines").alias("orders_items"),
        F.sum("money").alias("orders_money"),
        F.count(F.when(F.col("r_lines") > 0, 1)).alias("returns_count"),
        F.sum("r_lines").alias("returns_items"), F.sum("r_money").alias("returns_money"))

    def ratio(a, b):
        return F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")),
                                  F.lit(0.0)), 7)
    return per_cust.select(
        F.col("o_custkey").alias("user_sk"),
        ratio("returns_count", "orders_count").alias("order_ratio"),
        ratio("returns_items", "orders_items").alias("items_ratio"),
        ratio("returns_money", "orders_money").alias("monetary_ratio"),
        F.col("returns_count").cast("double").alias("frequency"))


def q20_return_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ratios of every customer (feature table of the segmentation)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount",
               "l_returnflag")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return return_ratios(li, o)


def q20_return_segments(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    f = q20_return_features(spark, sf_dir)
    return kmeans_segments(f, "user_sk", ["order_ratio", "items_ratio", "monetary_ratio",
                                          "frequency"], k=k)


def q25_rfm_features(spark: SparkSession, sf_dir: str, after: str = "2000-01-01",
                     today: str = "2001-08-01", days: int = 60) -> DataFrame:
    """Recency flag, order count and spend per customer over both channels
    ('F' store, 'O' web), orders after ``after``. One grouped pass per
    (customer, channel) replaces the reference's two inserts + union."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount",
               "l_linestatus")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").where(
        F.col("o_orderdate") >= F.to_timestamp_ntz(F.date_add(F.lit(after).cast("date"), 1)
                                                   .cast("string")))
    x = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("o_custkey").isNotNull())
    per_channel = x.groupBy("o_custkey", "l_linestatus").agg(
        F.countDistinct("l_orderkey").alias("frequency"),
        F.max(F.col("o_orderdate").cast("date")).alias("most_recent_date"),
        F.sum(net_paid()).alias("amount"))
    per_cust = per_channel.groupBy(F.col("o_custkey").alias("cid")).agg(
        F.max("most_recent_date").alias("_last"),
        F.sum("frequency").cast("double").alias("frequency"),
        F.sum("amount").cast("double").alias("totalspend"))
    return recency_flag(per_cust, "_last", today, days).select(
        "cid", "recency", "frequency", "totalspend")


def q25_rfm_segments(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    f = q25_rfm_features(spark, sf_dir)
    return kmeans_segments(f, "cid", ["recency", "frequency", "totalspend"], k=k)


def q26_book_club_features(spark: SparkSession, sf_dir: str, p_type: str = "ECONOMY",
                           n_classes: int = 15, min_lines: int = 5) -> DataFrame:
    """Per customer with more than ``min_lines`` lines of one category: line
    counts of brands 1..15 (a fixed-value pivot as conditional counts)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").where(
        F.col("p_type") == p_type)
    x = (li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
           .where(F.col("o_custkey").isNotNull()))
    aggs = [F.count(F.when(F.col("p_brand") == f"Brand#{i}", 1)).cast("double").alias(f"id{i}")
            for i in range(1, n_classes + 1)]
    g = x.groupBy(F.col("o_custkey").alias("cid")).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return g.where(F.col("_n") > min_lines).drop("_n").orderBy("cid")


def q26_book_clubs(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    f = q26_book_club_features(spark, sf_dir)
    return kmeans_segments(f, "cid", [f"id{i}" for i in range(1, 16)], k=k)


def q28_review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews with their part: 'test' when doc_id mod 10 = 0,
    else 'train' (the reference's 90/10 rule)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    return (d.join(lab, "doc_id")
             .select("doc_id", "quality",
                     F.when(F.pmod(F.col("doc_id"), F.lit(10)) == 0, "test").otherwise("train")
                      .alias("split")))


def q28_review_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on review words, trained on the 90 %, applied to the 10 %:
    (accuracy, n)."""
    return classifier_accuracy(review_predictions(spark, sf_dir, "quality"), "quality")


def review_predictions(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label, prediction) of the tenth of the labelled reviews held
    out; the text is read in one join."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    lab = table(spark, sf_dir, "labels", "doc_id", label).where(F.col(label).isNotNull())
    rows = d.join(lab, "doc_id").withColumn("is_test", F.pmod(F.col("doc_id"), F.lit(10)) == 0)
    return nb_text_classifier(rows, "is_test", "text", label, "doc_id")
