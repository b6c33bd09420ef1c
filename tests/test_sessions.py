"""Unit fixtures and properties for the time-ordered operators."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.sessions import (abandoned_sessions, balanced_prefix_sum,
                                         last_n_before, purchase_after_page, sessionize)


def _sessions(spark, rows, timeout=10):
    df = spark.createDataFrame(rows, "id long, u long, t long")
    out = sessionize(df, "u", "t", timeout)
    return {r.id: r.session_id for r in out.collect()}


def test_session_rules(spark):
    rows = [
        (1, 1, 0), (2, 1, 10),        # gap == timeout: same session
        (3, 1, 21),                   # gap timeout+1: new session
        (4, 1, 21),                   # equal time: same session
        (5, 2, 5),                    # one-click session of another user
        (6, None, 7),                 # NULL user: dropped
    ]
    s = _sessions(spark, rows)
    assert s == {1: "1_1", 2: "1_1", 3: "1_2", 4: "1_2", 5: "2_1"}


def test_session_bucket_stitching_matches_plain_window(spark):
    rnd = random.Random(7)
    rows, i = [], 0
    for u in range(5):
        t = 0
        for _ in range(200):
            t += rnd.choice([1, 3, 5, 9, 10, 11, 30, 200])
            i += 1
            rows.append((i, u, t))
    df = spark.createDataFrame(rows, "id long, u long, t long")
    w = Window.partitionBy("u").orderBy("t", "id")
    plain = (df.withColumn("n", F.when(F.col("t") - F.lag("t").over(w) > 10, 1).otherwise(0))
               .withColumn("sn", F.sum("n").over(w) + 1)
               .select("id", F.concat_ws("_", "u", "sn").alias("sid")))
    expect = {r.id: r.sid for r in plain.collect()}
    assert _sessions(spark, rows, timeout=10) == expect


def test_prefix_sum_across_buckets(spark):
    rows = [(1, 1, t, t % 3 == 0) for t in range(50)]
    df = spark.createDataFrame(rows, "id long, u long, t long, v boolean")
    for n in (1, 3, 20):
        out = balanced_prefix_sum(df, ["u"], "t", F.col("v").cast("int"), "p", tiebreak="id", partitions=n)
        assert {r.t: r.p for r in out.collect()} == {t: t // 3 + 1 for t in range(50)}


def test_prefix_sum_shares_follow_row_counts(spark):
    """Half of all rows on one user in one second: still several shares."""
    rows = [(i, 1, 5) for i in range(400)] + [(1000 + i, i % 7, i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, u long, t long").repartition(4)
    out = balanced_prefix_sum(df, ["u"], "t", F.lit(1), "p", tiebreak="id", partitions=8)
    got = {r.id: r.p for r in out.collect()}
    for u in range(7):
        mine = sorted((t, i) for i, v, t in rows if v == u)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_executed_scans_of_sessions(spark):
    import __spark_entry__ as E
    q = E.queries()
    for key, most in (("sessionize", 2), ("q02_viewed_with_item", 2)):
        df = q[key](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("events.parquet") <= most, key


def _clicks(spark, rows):
    return spark.createDataFrame(rows, "id long, u long, t long, kind string, item long")


def test_last_n_before(spark):
    day = 86400
    rows = [
        (1, 1, 0, "view", 11),
        (2, 1, 1 * day, "view", 12),          # exactly 10 days before the buy: kept
        (3, 1, 5 * day, "view", 13),
        (4, 1, 11 * day, "buy", 99),
        (5, 1, 11 * day + 1, "buy", 98),      # second purchase right after
        (6, 1, 12 * day, "view", 14),         # after the purchases: never counted
        (7, 2, 10 * day, "view", 50),         # other user's view
        (8, 3, 5, "view", 60), (9, 3, 6, "buy", 61),   # fewer than n views
    ]
    out = last_n_before(_clicks(spark, rows), "u", "t", "item", F.col("kind") == "view",
                        F.col("kind") == "buy", max_age=10 * day, n=2, tiebreak="id")
    got = sorted((r.purchased_item, r.lastviewed_item) for r in out.collect())
    # view 12 is 10 days + 1 s before purchase 98: outside the range for it
    assert got == [(61, 60), (98, 13), (99, 12), (99, 13)]


def test_purchase_after_page(spark):
    lim = 100
    rows = [
        (1, 1, 0, "review", None), (2, 1, 100, "buy", 1001),     # exactly at the limit
        (3, 2, 0, "review", None), (4, 2, 101, "buy", 1002),     # one second past
        (5, 3, 50, "buy", 1003), (6, 3, 60, "review", None),     # review after the sale
        (7, 4, 0, "review", None), (8, 5, 10, "buy", 1005),      # other user
        (9, 6, 10, "review", None), (10, 6, 250, "review", None), (11, 6, 300, "buy", 1006),
    ]
    df = spark.createDataFrame(rows, "id long, u long, t long, kind string, sale long")
    out = purchase_after_page(df, "u", "t", "kind", "sale", wanted="review", within=lim,
                              tiebreak="id")
    assert sorted(r.sale for r in out.collect()) == [1001, 1006]


def test_abandoned_sessions(spark):
    rows = [
        ("a", 1, "cart"), ("a", 2, "view"),                 # cart only
        ("b", 1, "cart"), ("b", 2, "checkout"),             # cart then checkout
        ("c", 1, "checkout"), ("c", 2, "cart"),             # checkout then cart
        ("d", 1, "view"),                                   # neither
    ]
    df = spark.createDataFrame(rows, "s string, t long, kind string")
    out = abandoned_sessions(df, "s", "t", "kind", "cart", "checkout")
    assert sorted((r.s, r.pagecount) for r in out.collect()) == [("a", 2), ("c", 2)]


def _random_clicks(seed, users=4, n=150):
    rnd = random.Random(seed)
    rows, i = [], 0
    for u in range(users):
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 1, 2, 5, 9, 10, 11, 25, 60])
            i += 1
            kind = rnd.choice(["view", "view", "buy", "other"])
            rows.append((i, u, t, kind, rnd.randrange(6)))
    return rows


def test_purchase_after_page_matches_brute_force(spark):
    for seed, lim in ((1, 10), (2, 25), (3, 0)):
        rows = _random_clicks(seed)
        df = spark.createDataFrame(rows, "id long, u long, t long, kind string, item long") \
            .withColumn("sale", F.when(F.col("kind") == "buy", F.col("id")))
        got = sorted(r.sale for r in purchase_after_page(
            df, "u", "t", "kind", "sale", wanted="view", within=lim, tiebreak="id").collect())
        want = sorted(
            s[0] for s in rows if s[3] == "buy"
            and any(p[1] == s[1] and p[3] == "view" and (p[2], p[0]) <= (s[2], s[0])
                    and s[2] - p[2] <= lim for p in rows))
        assert got == want, (seed, lim)


def test_last_n_before_matches_brute_force(spark):
    for seed, n, rng, width in ((4, 3, 30, 7), (5, 5, 100, 1000), (6, 1, 0, 3)):
        rows = _random_clicks(seed)
        out = last_n_before(_clicks(spark, rows), "u", "t", "item", F.col("kind") == "view",
                            F.col("kind") == "buy", max_age=rng, n=n, tiebreak="id")
        got = sorted((r.purchased_item, r.lastviewed_item) for r in out.collect())
        want = []
        for b in rows:
            if b[3] != "buy":
                continue
            views = sorted((v for v in rows if v[1] == b[1] and v[3] == "view"
                            and (v[2], v[0]) < (b[2], b[0])), key=lambda v: (v[2], v[0]))
            want += [(b[4], v[4]) for v in views[-n:] if b[2] - v[2] <= rng]
        assert got == sorted(want), (seed, n, rng)


def test_distribute_sort_together_keeps_a_key_in_one_partition(spark):
    from basketry.operators.sessions import distribute_sort
    df = spark.range(400).selectExpr("id % 7 AS u", "399 - id AS t")
    out = distribute_sort(df, ["u"], ["t"], partitions=5, together=True).withColumn("p", F.spark_partition_id())
    assert out.groupBy("u").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    for part in out.rdd.glom().collect():
        rows = [(r.u, r.t) for r in part]
        assert rows == sorted(rows)
