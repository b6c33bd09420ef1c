"""Loads, nested struct, logs, run jobs, result diff, plan properties."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.runs import result_diff, runs_compare, runs_minutes
from basketry.sources.delimited import load_delimited, multi_insert
from basketry.sources.logs import scan_querylog, scan_runlog
from basketry.sources.nested import (gen_nested, load_nested_text, nested_project,
                                     nested_to_columnar, nested_to_text)


def _write(text: str, name: str = "part.txt") -> str:
    d = tempfile.mkdtemp(prefix="basketry-test-")
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    return d


def test_load_delimited_hive_rules(spark):
    path = _write("1|a|2.5\n|b|x\n3||\n4\n\\N|\\N|1\n")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()),
                           T.StructField("v", T.DoubleType())])
    got = [tuple(r) for r in load_delimited(spark, path, schema).collect()]
    assert got == [(1, "a", 2.5), (None, "b", None), (3, "", None), (4, None, None),
                   (None, None, 1.0)]


def test_nested_round_trip_and_pruning(spark):
    base = spark.range(20).withColumnRenamed("id", "key")
    nested = gen_nested(base, "key", seed=5)
    d = tempfile.mkdtemp(prefix="basketry-test-")
    nested_to_text(nested).write.mode("overwrite").text(d + "/text")
    loaded = load_nested_text(spark, d + "/text")
    r = loaded.select("a.a1", "a.a4", "a.a5", "a.a9", "a.a14").orderBy("a14").first()
    assert len(r.a1) == 20 and r.a4 is None and len(r.a5) == 2 and r.a9 is False
    path = nested_to_columnar(loaded, d + "/pq")
    proj = nested_project(spark.read.parquet(path), [1, 14], limit=100)
    plan = proj._jdf.queryExecution().executedPlan().toString()
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "a1" in read_schema and "a14" in read_schema and "a2:" not in read_schema
    assert proj.count() == 20


def test_multi_insert_targets(spark):
    df = spark.range(10)
    out = multi_insert(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 3})
    got = sorted((r.id, r.target) for r in out.collect())
    assert (0, "even") in got and (0, "small") in got and (1, "small") in got
    assert len(got) == 5 + 3


def test_runlog_and_compare(spark):
    head = "|".join(f"h{i}" for i in range(11))
    lines = [head,
             "e|r|60000|2024-01-01|x|x|1|x|POWER|x|SUCCESS",
             "e|r|120000|2024-01-02|x|x|1|x|POWER|x|SUCCESS",
             "e|r|5|2024-01-02|x|x|2|x|POWER|x|FAILED",
             "e|r|90000|2024-01-03|x|x|3|x|POWER|x|SUCCESS"]
    a = scan_runlog(spark, _write("\n".join(lines) + "\n"))
    assert a.count() == 4 and a.where("failed").count() == 1
    assert sorted(r.minutes for r in runs_minutes(a).collect()) == [0.0, 1.0, 1.5, 2.0]
    b_lines = [head, "e|r|180000|2024-02-01|x|x|1|x|POWER|x|SUCCESS"]
    b = scan_runlog(spark, _write("\n".join(b_lines) + "\n"))
    cmp = runs_compare(a, b).collect()
    assert len(cmp) == 1 and cmp[0].query == 1 and cmp[0].change_percent == 100.0


def test_querylog(spark):
    d = tempfile.mkdtemp(prefix="basketry-test-")
    os.makedirs(d + "/query=q7")
    with open(d + "/query=q7/log.txt", "w") as f:
        f.write("Query ID = 1\nTime taken: 2.5 seconds, Fetched: 100 row(s)\nFAILED: boom\n")
    got = sorted(tuple(r) for r in scan_querylog(spark, d).collect())
    assert got == [("q7", "FAILED", None, None), ("q7", "SUCCESS", 2.5, 100.0)]


def test_result_diff(spark):
    e = spark.createDataFrame([(1,), (2,), (2,)], "x long")
    assert result_diff(e, e).count() == 0
    extra = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x long")
    assert [tuple(r) for r in result_diff(extra, e).collect()] == [("extra", 3)]
    two = spark.createDataFrame([(None,), (2,), (2,), (2,)], "x long")
    assert sorted(map(str, result_diff(two, e).collect())) == [
        "Row(side='extra', x=2)", "Row(side='extra', x=None)", "Row(side='missing', x=1)"]
    missing = spark.createDataFrame([(1,), (2,)], "x long")
    assert [tuple(r) for r in result_diff(missing, e).collect()] == [("missing", 2)]


def test_review_split_is_disjoint_and_complete(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    tagged = q["multi_insert"](spark, sf)
    per_doc = tagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert per_doc.where("n != 1").count() == 0
    labelled = spark.read.parquet(f"{sf}/labels.parquet").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "doc_id")
    assert tagged.count() == labelled.count()
    assert set(r.target for r in tagged.select("target").distinct().collect()) == {"train", "test"}


def test_orc_round_trip_with_pushdown(spark):
    from basketry.sources.delimited import to_columnar
    from basketry.sources.tables import scan_columnar
    d = tempfile.mkdtemp(prefix="basketry-test-")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    to_columnar(li, f"{d}/lineitem.orc", fmt="orc")
    got = (scan_columnar(spark, d, "lineitem", fmt="orc", columns=["l_orderkey", "l_quantity"])
           .where(F.col("l_quantity") > 40))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert got.count() == li.where(F.col("l_quantity") > 40).count()


def test_runs_average_repeats_and_engines(spark):
    from basketry.operators.runs import runs_average, runs_engines
    rows = ([("POWER", 1, 60000 * (i + 1), False, "hos") for i in range(8)]       # 8 repeats
            + [("POWER", 2, 1000, False, "sparksql")] * 9                        # 9 repeats count like any other number
            + [("POWER", 3, 5, True, "hot")])                                    # failed only
    runs = spark.createDataFrame(rows, "phase string, query int, duration_ms long, failed boolean, engine string")
    avg = {r.query: (r.repeats, r.avg_ms, r.avg_minutes) for r in runs_average(runs).collect()}
    assert avg == {1: (8, 270000.0, 4.5), 2: (9, 1000.0, 0.017)}
    eng = {r.query: tuple(r)[1:] for r in runs_engines(runs, ["hos", "hot", "sparksql"]).collect()}
    assert eng == {1: (270000.0, None, None), 2: (None, None, 1000.0)}


def test_nested_pruning_at_each_reference_width(spark):
    import re
    d = tempfile.mkdtemp(prefix="basketry-test-")
    base = spark.range(50).withColumnRenamed("id", "key")
    path = nested_to_columnar(gen_nested(base, "key", seed=1), d + "/pq")
    table = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # full ReadSchema text
    for width in (1, 5, 10, 15, 20, 30):
        leaves = list(range(1, width + 1))
        proj = nested_project(table, leaves, limit=100)
        plan = proj._jdf.queryExecution().executedPlan().toString()
        read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
        assert sorted(int(x) for x in re.findall(r"\ba(\d+):", read_schema)) == leaves, width
        assert proj.count() == 50
    spark.conf.unset("spark.sql.maxMetadataStringLength")
