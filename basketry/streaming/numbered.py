"""Numbered sessions as a stateful stream with event-time timers.

The batch ``sessionize`` rule (a gap longer than the timeout starts session
n + 1 of a user) on a stream whose clicks come late and out of order. A user's
state is the number of sessions closed so far and the open ones (first and last
click, count); a click opens one, widens one or joins two. When the watermark
is more than a timeout past an open session's last click, nothing can reach
that session any more, so it is closed, numbered and emitted. Sessions of a user
close in time order, so the numbers are those of the batch job. Clicks later
than the watermark delay are dropped by Spark.

Users are dealt to ``BUCKETS`` buckets by hash, and a bucket's users share one
state, one timer (for the earliest open session) and one call a batch, in which
they are merged column-wise: calls don't grow with the users. The number of
buckets belongs to a checkpoint and can't be changed under it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basketry.streaming.sessions import CLICK_SCHEMA

OUT = "user_id long, session_no long, first_us long, last_us long, clicks long"
STATE = ("users array<long>, closed array<long>, "  # sessions closed so far
         "user array<long>, first array<long>, last array<long>, clicks array<long>")  # the open ones
SESSION = ["user", "first", "last", "clicks"]
BUCKETS = 2048
AT_ONCE = 100_000  # clicks of a bucket that are taken in together, at least


def merged_users(sessions: pd.DataFrame, timeout: int) -> pd.DataFrame:
    """Sessions (user, first, last, clicks; a click is one of its own) with those
    joined that are no more than ``timeout`` apart, by user and time."""
    s = sessions.sort_values(["user", "first"], kind="stable")
    if s.empty:
        return s
    reach = s.groupby("user", sort=False)["last"].cummax().to_numpy()
    user, first, last, clicks = (s[c].to_numpy() for c in SESSION)
    new = np.ones(len(s), dtype=bool)
    new[1:] = (user[1:] != user[:-1]) | (first[1:] - reach[:-1] > timeout)
    at = np.flatnonzero(new)
    return pd.DataFrame({"user": user[at], "first": first[at], "last": np.maximum.reduceat(last, at),
                         "clicks": np.add.reduceat(clicks, at)})


def merged(sessions: list[tuple[int, int, int]], times: list[int], timeout: int) -> list[tuple[int, int, int]]:
    """Open sessions (first, last, clicks) of one user with further clicks taken in."""
    rows = pd.DataFrame([(0, *s) for s in sessions] + [(0, t, t, 1) for t in times], columns=SESSION, dtype="int64")
    return [tuple(map(int, r)) for r in merged_users(rows, timeout)[SESSION[1:]].itertuples(index=False)]


def _step(timeout: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        users = closed = np.empty(0, dtype="int64")
        sessions = pd.DataFrame({c: users for c in SESSION})
        if state.exists:
            users, closed, *held = (np.array(x, dtype="int64") for x in state.get)
            sessions = pd.DataFrame(dict(zip(SESSION, held)))
        waiting, n = [], 0

        def taken_in():
            return merged_users(pd.concat([sessions, *waiting], ignore_index=True), timeout)
        for b in batches:  # one Arrow batch of clicks at a time
            t = b["ts_us"].to_numpy(dtype="int64")
            waiting.append(pd.DataFrame({"user": b["user_id"].to_numpy(dtype="int64"), "first": t, "last": t,
                                         "clicks": np.ones(len(t), dtype="int64")}))
            n += len(t)
            if n >= max(AT_ONCE, len(sessions)):
                sessions, waiting, n = taken_in(), [], 0
        if waiting:
            sessions = taken_in()
        every = np.union1d(users, sessions["user"].to_numpy())
        counts = np.zeros(len(every), dtype="int64")
        counts[np.searchsorted(every, users)] = closed
        mark = state.getCurrentWatermarkMs() * 1000
        over = sessions["last"] + timeout < mark
        done, left = sessions[over], sessions[~over]
        place = np.searchsorted(every, done["user"].to_numpy())
        number = counts[place] + done.groupby("user").cumcount().to_numpy() + 1
        np.add.at(counts, place, 1)
        state.update((every.tolist(), counts.tolist(), *(left[c].tolist() for c in SESSION)))
        if len(left):  # the first millisecond at which the earliest open session is over
            state.setTimeoutTimestamp(max((int(left["last"].min()) + timeout) // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame({"user_id": done["user"], "session_no": number, "first_us": done["first"],
                            "last_us": done["last"], "clicks": done["clicks"]})
    return run


def numbered_sessions(clicks: DataFrame, timeout_us: int, delay: str, user: str = "user_id", ts: str = "ts",
                      buckets: int = BUCKETS) -> DataFrame:
    """Streaming ``clicks`` -> (user_id, session_no, first_us, last_us, clicks), each
    session once, when the watermark (``delay`` behind the latest click) has
    passed its end. Clicks without a user or time belong to nobody."""
    t = clicks.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(user).cast("long").alias("user_id"), F.col(ts).cast("timestamp").alias("_t"))
    t = t.withColumn("ts_us", F.unix_micros("_t")).withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return t.withWatermark("_t", delay).groupBy("bucket").applyInPandasWithState(
        _step(timeout_us), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_numbered(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, timeout_us: int,
                 delay: str, schema: T.StructType = CLICK_SCHEMA) -> None:
    """Take in the files that are new in ``source_dir``; the next run goes on from
    the checkpoint, with all open sessions."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (numbered_sessions(stream, timeout_us, delay).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
