"""Windows by prefix sums, fingerprints, bucketed pairs, refreshes, checked loads,
ordered lists and the numbered stream: hot keys, failures, odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.basket import heavy_pairs, make_pairs, pair_counts
from basketry.operators.joins import before_after
from basketry.operators.runs import result_diff
from basketry.operators.sessions import balanced_prefix_sums, collect_ordered
from basketry.sources.delimited import (load_checked, publish_refresh, read_refreshed, refresh_table, rejected_fields,
                                        stage_refresh)
from basketry.streaming.numbered import merged, run_numbered

SF = "/root/testdata/sf0.01"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_an_item_with_half_of_both_sides(spark):
    rnd = random.Random(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    facts = [(1 if i % 2 else rnd.randrange(2, 9), day(rnd.randrange(300)), rnd.randrange(1, 50) / 4, rnd.choice("FO")) for i in range(3000)]
    facts += [(None, day(3), 1.0, "F"), (1, None, 1.0, "F"), (1, day(5), None, "F"), (1, day(5), 2.0, None)]
    changes = [(1 if i % 2 else rnd.randrange(2, 12), i, day(rnd.randrange(300)), rnd.randrange(1, 90)) for i in range(400)]
    changes += [(1, 900, None, 5), (None, 901, day(4), 5), (1, 902, day(9), None), (1, 903, day(9), 0)]
    f = spark.createDataFrame(facts, "item int, day date, q double, ch string")
    c = spark.createDataFrame(changes, "item int, k int, start date, len int")
    out = before_after(f, c, "item", "day", "q", "start", "len", keys=["k"], split=F.col("ch"))
    got = {r.k: (r.after_F, r.before_F, r.after_O, r.before_O) for r in out.collect()}
    assert len(got) == len(changes)
    for item, k, s, n in changes:
        want = [0.0] * 4
        for fi, d, q, ch in facts:
            if item is not None and fi == item and None not in (s, n, d, q, ch) and s - dt.timedelta(n) <= d < s + dt.timedelta(n):
                want[(ch == "O") * 2 + (d < s)] += q
        assert got[k] == tuple(want), k


def test_prefix_sums_of_a_hot_key(spark):
    df = spark.range(4000).selectExpr("IF(id % 3 = 0, id, 0) AS g", "id AS t", "id % 7 AS v")
    got = balanced_prefix_sums(df, ["g"], ["t"], {"s": F.col("v"), "n": F.lit(1)}, partitions=9).where("g = 0").orderBy("t").collect()
    total = 0
    for i, r in enumerate(got):
        total += r.v
        assert (r.s, r.n) == (total, i + 1)


def test_equal_results_shuffle_fingerprints_only(spark):
    a = spark.range(200_000).selectExpr("id", "IF(id % 5 = 0, NULL, id) AS x", "CAST(id AS STRING) AS s")
    same = result_diff(a.orderBy(F.desc("id")), a)
    assert same.count() == 0 and "Exchange" not in physical(same).split("LocalTableScan")[0]
    # rows that only differ in which column is null, and in how often they occur
    x = spark.createDataFrame([(1, None), (None, 2), (3, 3), (3, 3)], "a int, b int")
    y = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "a int, b int")
    assert sorted(map(str, map(tuple, result_diff(x, y).collect()))) == sorted(map(str, [
        ("extra", 1, None), ("missing", None, 1), ("extra", 3, 3)]))
    one = a.withColumn("s", F.when(F.col("id") == 777, "changed").otherwise(F.col("s")))
    assert sorted((r.side, r.s) for r in result_diff(one, a).collect()) == [("extra", "changed"), ("missing", "777")]


def test_light_pairs_are_not_shuffled(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey")
    pairs = make_pairs(li, "l_orderkey", "l_partkey", min_support=2)
    left = heavy_pairs(pairs, 1)
    assert left.count() * 3 < pairs.count()
    want = {(r.item_1, r.item_2): r.cnt for r in pairs.groupBy("item_1", "item_2").agg(F.count("*").alias("cnt")).where("cnt > 1").collect()}
    assert {(r.item_1, r.item_2): r.cnt for r in pair_counts(li, "l_orderkey", "l_partkey", min_count=1).collect()} == want


def test_a_refresh_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    base, delta = spark.range(10), spark.range(100, 103)
    assert refresh_table(base, path, "base")
    staged = stage_refresh(delta, path)  # fails before it is published
    assert sorted(r.id for r in read_refreshed(spark, path).collect()) == list(range(10))
    assert refresh_table(delta, path, "r1") and not refresh_table(delta, path, "r1")
    assert not publish_refresh(spark, path, "r1", staged)  # a slow first attempt comes to its end
    rows = read_refreshed(spark, path)
    assert sorted(r.id for r in rows.collect()) == [*range(10), 100, 101, 102]
    assert {r.refresh for r in rows.select("refresh").distinct().collect()} == {"base", "r1"}
    with pytest.raises(ValueError):
        refresh_table(delta, path, "../x")


def test_loads_and_rejects_add_up(spark, tmp_path):
    lines = ["1|a|2.5", "x|b|y", "3|c", "", "4|d|1.0|more|", "\\N|\\N|\\N", "5||"]
    path = str(tmp_path / "in")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = T.StructType.fromDDL("a int, b string, c double")
    loaded = load_checked(spark, path, schema)
    got = [(r.a, r.b, r.c, r._line) for r in loaded.collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 2.5, None), (None, "b", None, "x|b|y"), (3, "c", None, "3|c"), (None, None, None, ""),
                                           (4, "d", 1.0, "4|d|1.0|more|"), (None, None, None, None), (5, "", None, None)], key=str)
    faults = sorted(map(tuple, rejected_fields(loaded).collect()), key=str)
    assert faults == sorted([("a", "type", "x", "x|b|y"), ("c", "type", "y", "x|b|y"), ("c", "missing", None, "3|c"), ("b", "missing", None, ""),
                             ("c", "missing", None, ""), (None, "surplus", "more|", "4|d|1.0|more|")], key=str)
    assert loaded.where("_line IS NULL").count() + loaded.where("_line IS NOT NULL").count() == len(lines)


def test_ordered_lists_in_chunks(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 2 else rnd.choice("abc"), rnd.randrange(500), i, rnd.choice(["x", "y", None])) for i in range(900)] + [(None, 1, 1, "x")]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string")
    got = {}
    for r in collect_ordered(df, ["k"], ["t", "id"], "v", chunk=40).orderBy("k", "chunk_no").collect():
        assert len(r["items"]) <= 40
        got.setdefault(r.k, []).extend(r["items"])
    want = {}
    for k, _, _, v in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(k, []).append(v)
    assert got == want


def test_open_sessions_merge():
    assert merged([(0, 5, 3), (20, 20, 1)], [12, 100, 13], 7) == [(0, 20, 6), (100, 100, 1)]
    assert merged([], [5, 5, 12, 20], 7) == [(5, 12, 3), (20, 20, 1)]


def test_numbered_stream_with_late_clicks_and_restarts(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    slices = [[(1, 0), (1, 30), (2, 10), (1, 300)],
              [(1, 60), (1, 290), (2, 200), (None, 5), (1, 420)],    # 60 and 290 come late
              [(1, 900), (2, 900)], [(9, 100_000)]]
    path, n = str(tmp_path), 0
    for s in slices:
        rows = []
        for u, m in s:
            n += 1
            rows.append((n, at(m), u))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run_numbered(spark, f"{path}/in", f"{path}/out", f"{path}/ckpt", 3600 * 10**6, "10 hours", T.StructType.fromDDL(schema))
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r.user_id, r.session_no, (r.first_us // 10**6 - base) // 60, (r.last_us // 10**6 - base) // 60, r.clicks)
                 for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(1, 1, 0, 60, 3), (1, 2, 290, 300, 2), (1, 3, 420, 420, 1), (1, 4, 900, 900, 1),
                   (2, 1, 10, 10, 1), (2, 2, 200, 200, 1), (2, 3, 900, 900, 1)]


def test_many_users_share_calls(spark, tmp_path):
    from basketry.streaming import numbered
    rnd = random.Random(5)
    schema, path, us = "event_id long, ts timestamp_ntz, user_id long", str(tmp_path), 60 * 10**6
    clicks = [(rnd.choice([rnd.randrange(-3, 400), 2**60]), rnd.randrange(3000)) for _ in range(4000)]
    clicks.sort(key=lambda c: c[1] + rnd.randrange(300))  # late by less than the delay
    for part in (clicks[:1500], clicks[1500:3000], clicks[3000:], [(-9, 10**6)]):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), u) for i, (u, m) in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run_numbered(spark, f"{path}/in", f"{path}/out", f"{path}/ckpt", 60 * us, "10 hours", T.StructType.fromDDL(schema))
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    want = []
    for user in {u for u, _ in clicks}:
        for i, s in enumerate(merged([], [base + m * us for u, m in clicks if u == user], 60 * us)):
            want.append((user, i + 1, *s))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").where("user_id <> -9").collect())) == sorted(want)
    # one call takes in all users of a bucket, its clicks in several Arrow batches
    import pandas as pd

    class State:
        exists, kept, timer = False, None, None
        get = property(lambda self: self.kept)
        getCurrentWatermarkMs = lambda self: 10
        setTimeoutTimestamp = lambda self, at: setattr(self, "timer", at)

        def update(self, row):
            self.exists, self.kept = True, row
    state, step = State(), numbered._step(2000)
    batches = [pd.DataFrame({"user_id": [1, 2, 1], "ts_us": [0, 9000, 5000]}), pd.DataFrame({"user_id": [2, 1], "ts_us": [1000, 1500]})]
    out = pd.concat(step((0,), iter(batches), state))
    assert out.values.tolist() == [[1, 1, 0, 1500, 2], [1, 2, 5000, 5000, 1], [2, 1, 1000, 1000, 1]]
    assert state.kept == ([1, 2], [2, 1], [2], [9000], [9000], [1]) and state.timer == 12


def test_many_pairs_are_counted_without_buckets(spark, monkeypatch):
    from basketry.operators import basket
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 3, 4, None]), rnd.choice([*range(12), None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "b int, i int")
    sets = {b: {i for c, i in rows if c == b and i is not None} for b in (1, 2, 3, 4)}
    count = {}
    for s in sets.values():
        for x in s:
            for y in s:
                if x < y:
                    count[x, y] = count.get((x, y), 0) + 1
    want = {k: n for k, n in count.items() if n > 1}
    called, buckets = [], basket.heavy_pairs
    monkeypatch.setattr(basket, "heavy_pairs", lambda *a: called.append(1) or buckets(*a))

    def got():
        return {(r.item_1, r.item_2): r.cnt for r in pair_counts(df, "b", "i", min_count=1).collect()}
    assert got() == want and len(called) == 1
    monkeypatch.setattr(basket, "MOST", 64)  # bitmaps keep their size; fewer than the pairs
    assert sum(count.values()) > 64 and got() == want and len(called) == 1
    monkeypatch.setattr(basket, "HOT", 3)
    assert got() == want and len(called) == 1
    assert pair_counts(df.where("b IS NULL"), "b", "i", min_count=1).count() == 0


def test_rows_are_narrowed_when_all_ranges_differ(spark, monkeypatch):
    from basketry.operators import runs
    x = spark.range(60_000).selectExpr("id", "IF(id % 5 = 0, NULL, id) AS v", "CAST(id % 7 AS DOUBLE) AS w")
    y = x.where("id % 50 <> 0").unionByName(x.where("id % 75 = 1")).unionByName(x.where("id = 11"))
    want = sorted([("missing", i, None if i % 5 == 0 else i) for i in range(0, 60_000, 50)] + [
        ("extra", i, None if i % 5 == 0 else i) for i in [*range(1, 60_000, 75), 11]], key=str)
    monkeypatch.setattr(runs, "RANGES", 4)  # so that rows differ in every range
    kept, narrow = [], runs._may_differ

    def counting(differing):
        f = narrow(differing)

        def g(t):
            out = f(t)
            kept.append(out.count())
            return out
        return g
    monkeypatch.setattr(runs, "_may_differ", counting)
    for most in (runs.MOST_BITS, 1 << 16):
        monkeypatch.setattr(runs, "MOST_BITS", most)
        assert sorted(((r.side, r.id, r.v) for r in result_diff(y, x).collect()), key=str) == want
    # 2001 rows differ of 60,000 a side
    assert len(kept) == 4 and max(kept) < 12_000, kept
