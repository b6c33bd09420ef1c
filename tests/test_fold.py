"""Ordered reducers by a segmented fold, against plain per-key loops."""

import random

import numpy as np
import pytest

from basketry.operators.fold import NEVER, LastSeen, SeenBefore, Sessions, segmented_fold

TIMEOUT, WITHIN, N = 10, 15, 3
SCHEMA = "u string, v long, t long, id long, cart long, checkout long, view long, buy long"


def clicks(seed=2, n=1200):
    """Half of all rows are one key's; keys of one row; nulls."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        u = "hot" if i % 2 else rnd.choice("abcdefghijklmnopqrstuvwxyz")
        t = rnd.randrange(2500 if u == "hot" else 400)
        kind = rnd.randrange(6)
        rows.append((u, 0 if u != "b" else rnd.randrange(2), t, i, t if kind == 0 else None, t if kind == 1 else None,
                     rnd.randrange(9) if kind in (2, 3) else None, 100 + rnd.randrange(9) if kind == 4 else None))
    return rows + [("once", 0, 5, 9000, 5, None, None, None), (None, 0, 5, 9001, 5, None, 1, None),
                   ("a", None, 5, 9002, 5, None, 1, None), ("a", 0, None, 9003, None, None, 1, None)]


def by_key(rows):
    out = {}
    for r in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[1], r[2], r[3])):
        out.setdefault((r[0], r[1]), []).append(r)
    return out


def sessions(rows):
    for key, rs in by_key(rows).items():
        number, run = 0, []
        for r in [*rs, None]:
            if run and (r is None or r[2] - run[-1][2] > TIMEOUT):
                number += 1
                yield (*key, number, len(run), *(max((x[c] for x in run if x[c] is not None), default=None) for c in (4, 5)))
                run = []
            run.append(r)


def seen_before(rows):
    for key, rs in by_key(rows).items():
        last = None
        for r in rs:
            last = r[2] if r[6] is not None else last
            if r[7] is not None and last is not None and r[2] - last <= WITHIN:
                yield (*key, r[3])


def last_seen(rows):
    for key, rs in by_key(rows).items():
        views = []
        for r in rs:
            if r[6] is not None:
                views.append(r)
            if r[7] is not None:
                yield from ((*key, r[7], v[6]) for v in views[-N:] if r[2] - v[2] <= WITHIN)


def machine_of(name):
    return {"sessions": (Sessions("t", "cart", "checkout", TIMEOUT), ["t", "cart", "checkout"], sessions),
            "seen": (SeenBefore("t", "seen", "sale", WITHIN), ["t", "seen", "sale"], seen_before),
            "last": (LastSeen("t", "view", "buy", WITHIN, N), ["t", "view", "buy"], last_seen)}[name]


@pytest.mark.parametrize("name", ["sessions", "seen", "last"])
@pytest.mark.parametrize("parts", [1, 7, 60])
def test_equals_a_loop_per_key(spark, name, parts):
    rows = clicks()
    machine, columns, brute = machine_of(name)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "CASE WHEN view IS NOT NULL THEN t END AS seen", "CASE WHEN buy IS NOT NULL THEN id END AS sale")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # keys span batches, too
    try:
        got = segmented_fold(df, ["u", "v"], ["t", "id"], machine, columns, parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("name", ["sessions", "seen", "last"])
def test_merge_is_associative_and_folds_pieces(name):
    machine, columns, _ = machine_of(name)
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n = int(rnd.integers(3, 20))
        t = np.sort(rnd.integers(0, 80, n))
        rows = {"t": t}
        for c in columns[1:]:
            rows[c] = np.where(rnd.random(n) < 0.4, t if c in ("cart", "checkout", "seen") else rnd.integers(0, 9, n), NEVER)
        cut = sorted(rnd.integers(0, n + 1, 2).tolist())
        one = np.zeros(1, np.int64)

        def fold(a, z):
            return machine.fold({c: v[a:z] for c, v in rows.items()}, one) if z > a else machine.zero(1)
        a, b, c = fold(0, cut[0]), fold(cut[0], cut[1]), fold(cut[1], n)
        left, right, whole = machine.merge(machine.merge(a, b), c), machine.merge(a, machine.merge(b, c)), fold(0, n)
        for s in machine.state:
            assert left[s][0] == right[s][0] == whole[s][0], s


def test_no_rows(spark):
    machine, columns, _ = machine_of("sessions")
    df = spark.createDataFrame([], SCHEMA)
    assert segmented_fold(df, ["u"], ["t", "id"], machine, columns).collect() == []


def test_clicks_with_odd_items(spark, tmp_path):
    from basketry.sources.tables import clicks as read
    rows = [(1, 1, "view", 1.0, '{"k": "x"}'), (2, 1, "view", 1.0, '{"k": 1.5}'), (3, 1, "view", 1.0, "{broken"),
            (4, 1, "view", 1.0, None), (5, 1, "view", 1.0, '{"k": 7}')]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.event_id: r.item for r in read(spark, str(tmp_path)).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 7}
