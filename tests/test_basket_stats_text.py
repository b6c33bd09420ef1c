"""Unit fixtures for pairs, statistics, joins and text operators."""

import itertools
import math
import random

from pyspark.sql import functions as F

from basketry.operators.aggregates import agg_linreg, agg_stddev_cov
from basketry.operators.basket import make_pairs, pair_counts
from basketry.operators.joins import before_after, join_contains, join_scalar
from basketry.operators.text import extract_sentiment, find_company


def test_pairs_rules(spark):
    rows = [(1, 10), (2, 10), (2, 10), (2, None), (3, 1), (3, 2), (3, 3)]
    df = spark.createDataFrame(rows, "b long, i long")
    got = sorted(tuple(r) for r in make_pairs(df, "b", "i").collect())
    assert got == [(3, 1, 2), (3, 1, 3), (3, 2, 3)]


def test_pairs_count_property_and_salt(spark):
    rnd = random.Random(3)
    rows = [(b, rnd.randrange(12)) for b in range(60) for _ in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame(rows, "b long, i long")
    n_by_b = {}
    for b, i in set(rows):
        n_by_b.setdefault(b, set()).add(i)
    expect_total = sum(len(s) * (len(s) - 1) // 2 for s in n_by_b.values())
    plain = make_pairs(df, "b", "i")
    assert plain.count() == expect_total
    assert plain.where(F.col("item_1") >= F.col("item_2")).count() == 0
    salted = make_pairs(df, "b", "i", hot=2)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    # support pruning is exact for "count > n"
    exact = {}
    for s in n_by_b.values():
        for a, c in itertools.combinations(sorted(s), 2):
            exact[(a, c)] = exact.get((a, c), 0) + 1
    got = {(r.item_1, r.item_2): r.cnt for r in pair_counts(df, "b", "i", min_count=3).collect()}
    assert got == {k: v for k, v in exact.items() if v > 3}


def test_linreg_cases(spark):
    rows = [("one", 1, 5.0),
            ("flat", 1, 2.0), ("flat", 2, 2.0),
            ("down", 1, 3.0), ("down", 2, 1.0),
            ("up", 1, 1.0), ("up", 2, 2.0), ("up", 3, 3.0)]
    df = spark.createDataFrame(rows, "g string, x long, y double")
    got = {r.g: (r.slope, r.intercept) for r in agg_linreg(df, ["g"], "x", "y").collect()}
    assert got["one"][0] is None
    assert got["flat"] == (0.0, 2.0)
    assert got["down"] == (-2.0, 5.0)
    assert got["up"] == (1.0, 0.0)


def test_cov_cases(spark):
    rows = [("one", 4.0), ("zero", -1.0), ("zero", 1.0), ("two", 1.0), ("two", 3.0)]
    df = spark.createDataFrame(rows, "g string, q double")
    got = {r.g: r.cov for r in agg_stddev_cov(df, ["g"], "q").collect()}
    assert got["one"] is None
    assert got["zero"] is None
    assert math.isclose(got["two"], math.sqrt(2) / 2, rel_tol=1e-4)
    kept = agg_stddev_cov(df, ["g"], "q", min_cov=0.707105).collect()  # equal to the limit
    assert [r.g for r in kept] == ["two"]


def test_before_after_window_edges(spark):
    changes = spark.createDataFrame([(1, "2020-01-10", 5)], "item long, start string, len int") \
        .withColumn("start", F.col("start").cast("date"))
    sales = spark.createDataFrame(
        [(1, "2020-01-10", 1.0),   # start day: after
         (1, "2020-01-05", 2.0),   # start - len: before
         (1, "2020-01-15", 4.0),   # start + len: neither
         (2, "2020-01-10", 8.0)],  # other item
        "item long, day string, q double").withColumn("day", F.col("day").cast("date"))
    r = before_after(sales, changes, "item", "day", "q", "start", "len").collect()[0]
    assert (r.after, r.before) == (1.0, 2.0)


def test_join_scalar_one_row(spark):
    a = spark.range(10).agg(F.count(F.lit(1)).alias("n"))
    b = spark.range(5).agg(F.sum("id").alias("s"))
    assert [tuple(r) for r in join_scalar(a, b).collect()] == [(10, 10)]


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", "POS"), ("bad", "NEG")], "word string, sentiment string")
    docs = spark.createDataFrame(
        [(1, "Good and bad. Nothing here! BAD"), (2, ""), (3, None)], "id long, text string")
    got = sorted(tuple(r) for r in extract_sentiment(docs, ["id"], "text", lex).collect())
    assert got == [(1, " bad", "NEG", "bad"), (1, "good and bad", "NEG", "bad"),
                   (1, "good and bad", "POS", "good")]


def test_find_company_whole_words(spark):
    names = spark.createDataFrame([("Acme",), ("Zeta",)], "name string")
    docs = spark.createDataFrame([(1, "Acme rocks. zetas are not zeta"), (2, "acmecorp")],
                                 "id long, text string")
    got = sorted(tuple(r) for r in find_company(docs, ["id"], "text", names).collect())
    assert got == [(1, "acme", "acme rocks"), (1, "zeta", " zetas are not zeta")]


def test_join_contains_matches_brute_force(spark):
    rnd = random.Random(5)
    words = ["the", "quick", "fox", "a", "é", "lazy-dog", "x.y", "over"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))).title()) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "xquick foxy"), (103, "tab\tquick fox\nnew")]
    names = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    names += ["", None, "ick", "q", "QUICK FOX", "k f", "  ", "a  b c", "oxy"]
    docs = spark.createDataFrame(texts, "id long, text string")
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted(tuple(r) for r in join_contains(docs, "id", "text", df, "n").select("id", "matched_name").collect())
    want = sorted((i, n) for i, t in texts if t for n in {n.lower() for n in names if n} if n in t.lower())
    assert got == want
    plan = join_contains(docs, "id", "text", df, "n")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_dictionary_entries_of_several_words(spark):
    docs = spark.createDataFrame([(1, "Acme Corp rocks. Acme too."), (2, "e-mart is here. A mart.")], "id long, t string")
    names = spark.createDataFrame([("acme corp",), ("e-mart",), ("12",)], "name string")
    got = sorted((r.id, r.company_name, r.review_sentence) for r in find_company(docs, ["id"], "t", names).collect())
    assert got == [(1, "acme corp", "acme corp rocks"), (2, "e-mart", "e-mart is here")]


def test_giant_basket_is_paired_in_shares(spark):
    df = spark.range(60).selectExpr("1L AS b", "id AS i").unionByName(spark.range(6).selectExpr("id + 2 AS b", "id AS i"))
    assert make_pairs(df, "b", "i", hot=10).count() == 60 * 59 // 2
    assert make_pairs(df, "b", "i", hot=10).distinct().count() == 60 * 59 // 2


def test_linreg_leaves_null_values_out(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, None)], "g int, x double, y double")
    r = agg_linreg(df, ["g"], "x", "y").head()
    assert abs(r.slope - 1.0) < 1e-12 and abs(r.intercept - 1.0) < 1e-12


def test_join_scalar_refuses_equal_names(spark):
    import pytest
    with pytest.raises(ValueError):
        join_scalar(spark.range(1), spark.range(2))


def test_return_ratio_cases(spark):
    from basketry.plans.ml_jobs import return_ratios
    lines = spark.createDataFrame(
        [(1, 100.0, 0.0, "N"),                       # customer 10: no returns
         (2, 100.0, 0.0, "R"), (2, 300.0, 0.0, "N"),  # customer 20: order partly returned
         (3, 0.0, 0.0, "R")],                         # customer 30: zero paid, returned
        "l_orderkey long, l_extendedprice double, l_discount double, l_returnflag string")
    orders = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "o_orderkey long, o_custkey long")
    got = {r.user_sk: tuple(r)[1:] for r in return_ratios(lines, orders).collect()}
    assert got[10] == (0.0, 0.0, 0.0, 0.0)
    assert got[20] == (1.0, 0.5, 0.25, 1.0)
    assert got[30] == (1.0, 1.0, 0.0, 1.0)           # 0 / 0 money -> 0.0


def test_elasticity_zero_change_is_null(spark):
    from basketry.plans.stats import cross_price_elasticity
    changes = spark.createDataFrame(
        [(1, 10, "2020-01-10", 5, 0.10), (1, 11, "2020-02-10", 5, 0.0)],
        "item long, imp_sk long, imp_start_date string, no_days_comp_price int, price_change double"
    ).withColumn("imp_start_date", F.col("imp_start_date").cast("date"))
    sales = spark.createDataFrame(
        [(1, "2020-01-07", 2.0, "F"), (1, "2020-01-11", 3.0, "O"),
         (1, "2020-02-07", 2.0, "F"), (1, "2020-02-11", 4.0, "F")],
        "item long, sold string, qty double, ch string").withColumn("sold", F.col("sold").cast("date"))
    r = cross_price_elasticity(sales, changes).collect()[0]
    # window 10: (3 - 2) / (2 * 0.1) = 5; window 11: change 0 -> NULL, ignored by avg
    assert float(r.cross_price_elasticity) == 5.0


def test_classifier_accuracy(spark):
    from basketry.operators.ml import classifier_accuracy
    pred = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)],
                                 "quality double, prediction double")
    r = classifier_accuracy(pred, "quality").collect()[0]
    assert (r.accuracy, r.n) == (0.75, 4)


def test_join_contains_distinct_payload(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, text string")
    names = spark.createDataFrame([("alpha", 7), ("beta", 7), ("gamma", 8), ("beta", 9)],
                                  "n string, store long")
    every = join_contains(docs, "id", "text", names, "n", carry=["store"])
    once = join_contains(docs, "id", "text", names, "n", carry=["store"], distinct_payload=True)
    assert sorted((r.id, r.store) for r in every.collect()) == [(1, 7), (1, 7), (1, 9), (2, 8)]
    assert sorted((r.id, r.store, r.matched_name) for r in once.collect()) == [
        (1, 7, "alpha"), (1, 9, "beta"), (2, 8, "gamma")]


def test_before_after_matches_brute_force(spark):
    import datetime as dt
    rnd = random.Random(11)
    base = dt.date(2020, 1, 1)
    changes = [(rnd.randrange(4), k, base + dt.timedelta(days=rnd.randrange(60)), rnd.randrange(0, 15))
               for k in range(12)]
    sales = [(rnd.randrange(5), base + dt.timedelta(days=rnd.randrange(-20, 90)), float(rnd.randrange(1, 9)),
              rnd.choice("FO")) for _ in range(300)]
    cdf = spark.createDataFrame(changes, "item long, k long, start date, len int")
    sdf = spark.createDataFrame(sales, "item long, day date, q double, ch string")
    got = {(r.item, r.k): (r.after_F, r.before_F, r.after_O, r.before_O) for r in before_after(
        sdf, cdf, "item", "day", "q", "start", "len", keys=["k"], split=F.col("ch")).collect()}
    want = {}
    for item, k, start, ln in changes:
        acc = {"aF": 0.0, "bF": 0.0, "aO": 0.0, "bO": 0.0}
        for si, day, q, ch in sales:
            if si != item:
                continue
            if start <= day < start + dt.timedelta(days=ln):
                acc["a" + ch] += q
            elif start - dt.timedelta(days=ln) <= day < start:
                acc["b" + ch] += q
        want[(item, k)] = (acc["aF"], acc["bF"], acc["aO"], acc["bO"])
    assert got == want
