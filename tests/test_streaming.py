"""The streaming session query emits the same sessions as the batch operator."""

import tempfile

from pyspark.sql import functions as F

from basketry.operators.sessions import sessionize
from basketry.streaming.sessions import run_sessions


def test_stream_sessions_equal_batch(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    d = tempfile.mkdtemp(prefix="basketry-stream-")
    # the click files arrive in two parts; a closing click far in the future
    # moves the watermark past every real session
    events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) \
        .write.parquet(d + "/in/part1")
    events.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) \
        .write.parquet(d + "/in/part2")
    closing = spark.createDataFrame(
        [(-1, "2030-01-01 00:00:00", -1, "view", 0.0, "{}")],
        "event_id long, ts string, user_id long, event_type string, value double, props string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    closing.write.parquet(d + "/in/part3")
    got = run_sessions(spark, d + "/in/*", d + "/out", d + "/ckpt",
                       gap="1 hour", watermark="1 hour").where("user_id >= 0")
    # batch twin: gap in microseconds; session_window merges clicks closer
    # than the gap, the batch rule keeps a gap equal to the timeout together
    clicks = events.select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    s = sessionize(clicks, "user_id", "t", 3600 * 10**6)
    want = s.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("clicks"),
                                                  F.min("t").alias("first"))
    a = sorted((r.user_id, r.clicks, int(r.first_click.timestamp() * 10**6))
               for r in got.select("user_id", "clicks", F.col("first_click")).collect())
    b = sorted((r.user_id, r.clicks, r.first) for r in want.collect())
    assert a == b
