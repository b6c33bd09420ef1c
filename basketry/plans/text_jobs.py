"""Review text jobs (reference q10, q18, q19, q27).

Reviews are ``documents`` (review id = item id = doc_id); the lexicon and
the company dictionary are DataFrame arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import days_of_weeks
from basketry.operators.aggregates import agg_linreg
from basketry.operators.filters import date_range_filter
from basketry.operators.joins import join_contains
from basketry.operators.text import extract_sentiment, find_company, lexicon_df
from basketry.sources.delimited import ctas_temp
from basketry.sources.tables import net_paid, table


def _ordered(spark, found, *order):
    """The rows found, in order. They are written first: a global sort samples its
    input before it shuffles it, which would read and split all texts twice."""
    return ctas_temp(spark, found, "text-hits").orderBy(*order)


def _reviews(spark, sf_dir, lang=None):
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    if lang is not None:
        d = d.where(F.col("lang") == lang)
    return d


def q10_sentiment(spark: SparkSession, sf_dir: str, lang: str | None = None,
                  lexicon: dict | None = None) -> DataFrame:
    """Polar sentences of all reviews (of one language if given): (item_sk, sentence, POS|NEG, word)."""
    d = _reviews(spark, sf_dir, lang).select(F.col("doc_id").alias("item_sk"), "text")
    out = extract_sentiment(d, ["item_sk"], "text", lexicon_df(spark, lexicon))
    return _ordered(spark, out, "item_sk", "review_sentence", "sentiment", "sentiment_word")


def declining_stores(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """Suppliers whose daily net sales in [start, end] have slope <= 0."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice",
               "l_discount")
    o = date_range_filter(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", start, end)
    daily = (li.join(o, li.l_orderkey == o.o_orderkey)
               .groupBy(F.col("l_suppkey").alias("store"),
                        F.datediff(F.col("o_orderdate").cast("date"),
                                   F.lit(start).cast("date")).alias("x"))
               .agg(F.sum(net_paid()).cast("double").alias("y")))
    return agg_linreg(daily, ["store"], "x", "y").where(F.col("slope") <= 0).select("store")


def q18_declining_store_reviews(spark: SparkSession, sf_dir: str, start: str = "1997-01-01",
                                end: str = "1997-12-31", lexicon: dict | None = None) -> DataFrame:
    """Negative sentences of reviews that name a store with falling sales.

    Store name = the ``benchmark`` text whose item_id is the supplier key;
    a review names the store when the whole name occurs in it (any case).
    """
    stores = declining_stores(spark, sf_dir, start, end)
    names = (table(spark, sf_dir, "benchmark", "item_id", "text")
             .join(stores, F.col("item_id") == F.col("store"), "left_semi")
             .select(F.col("item_id").alias("store"), F.lower("text").alias("matched_name")))
    docs = _reviews(spark, sf_dir).select("doc_id", "text")
    # one row per (review, store)
    hits = join_contains(docs, "doc_id", "text", names, "matched_name", carry=["store"],
                         distinct_payload=True).select("store", "doc_id", "text")
    out = extract_sentiment(hits, ["store", "doc_id"], "text", lexicon_df(spark, lexicon), only="NEG")
    return _ordered(spark, out, "store", "doc_id", "review_sentence", "sentiment_word")


# A day of every month of 1997, the middle of the test tables' ship dates; the
# job looks at the whole weeks that hold them.
Q19_DATES = [f"1997-{m:02d}-{5 + m:02d}" for m in range(1, 13)]


def q19_returned_both(spark: SparkSession, sf_dir: str, dates: list[str] | None = None,
                      tol: float = 0.1, lexicon: dict | None = None) -> DataFrame:
    """Negative review sentences of parts returned, in the weeks of ``dates``,
    in about equal quantity (within ``tol`` of the mean) through the store
    ('F') and web ('O') channels."""
    dates = sorted(dates or Q19_DATES)
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_returnflag",
               "l_linestatus", "l_shipdate").where(F.col("l_returnflag") == "R")
    # the hull of the weeks reaches the reader; the weeks themselves decide
    hull = li.where((F.col("l_shipdate") >= F.to_timestamp_ntz(F.date_sub(F.lit(dates[0]).cast("date"), 6).cast("string")))
                    & (F.col("l_shipdate") < F.to_timestamp_ntz(F.date_add(F.lit(dates[-1]).cast("date"), 7).cast("string"))))
    r = hull.join(days_of_weeks(spark, dates), F.col("l_shipdate").cast("date") == F.col("day"), "left_semi")
    per = r.groupBy("l_partkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("sr"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("wr"))
    items = per.where((F.col("sr") > 0) & (F.col("wr") > 0)
                      & (F.abs(F.col("sr") - F.col("wr")) / ((F.col("sr") + F.col("wr")) / 2.0) <= tol))
    docs = (_reviews(spark, sf_dir).join(items, F.col("doc_id") == F.col("l_partkey"), "left_semi")
            .select(F.col("doc_id").alias("item_sk"), "text"))
    out = extract_sentiment(docs, ["item_sk"], "text", lexicon_df(spark, lexicon), only="NEG")
    return out.orderBy("item_sk", "review_sentence", "sentiment", "sentiment_word")


def company_names(spark: SparkSession, sf_dir: str, min_len: int = 5) -> DataFrame:
    """Made-up company dictionary: long first words of the benchmark texts."""
    b = table(spark, sf_dir, "benchmark", "text")
    first = F.regexp_extract(F.lower("text"), "^\\p{L}+", 0)
    return (b.select(first.alias("name")).where(F.length("name") >= min_len).distinct())


def q27_competitors(spark: SparkSession, sf_dir: str, item: int | None = None) -> DataFrame:
    """Competitor names mentioned in reviews: (review_sk, item_sk, company_name, sentence)."""
    d = _reviews(spark, sf_dir)
    if item is not None:
        d = d.where(F.col("doc_id") == item)
    d = d.select(F.col("doc_id").alias("review_sk"), F.col("doc_id").alias("item_sk"), "text")
    out = find_company(d, ["review_sk", "item_sk"], "text", company_names(spark, sf_dir))
    return _ordered(spark, out, "review_sk", "item_sk", "company_name", "review_sentence")
