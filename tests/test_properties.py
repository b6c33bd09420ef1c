
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.operators.basket import pair_counts, pair_counts_bounded
from basketry.operators.sessions import sessionize

clicks = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None)
@given(rows=clicks, timeout=st.integers(0, 40))
def test_sessions_partition_rows_and_respect_the_timeout(spark, rows, timeout):
    data = [(i, u, t) for i, (u, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, u long, t long")
    out = {r.id: r.session_id for r in sessionize(df, "u", "t", timeout).collect()}
    assert sorted(out) == [i for i, _, _ in data]          # every click exactly once
    by_user = {}
    for i, u, t in data:
        by_user.setdefault(u, []).append((t, i))
    for u, evs in by_user.items():
        evs.sort()
        numbers = [int(out[i].split("_")[1]) for _, i in evs]
        assert all(out[i].startswith(f"{u}_") for _, i in evs)
        assert numbers[0] == 1
        for (t0, i0), (t1, i1), n0, n1 in zip(evs, evs[1:], numbers, numbers[1:]):
            gap = t1 - t0
            assert n1 == n0 + (1 if gap > timeout else 0)   # split exactly at long gaps


baskets = st.lists(st.tuples(st.integers(0, 15), st.integers(0, 6)), min_size=1, max_size=80)


@settings(max_examples=10, deadline=None)
@given(rows=baskets)
def test_bounded_and_join_pair_counts_agree(spark, rows):
    df = spark.createDataFrame(rows, "b long, i long")
    a = sorted(tuple(r) for r in pair_counts(df, "b", "i").collect())
    b = sorted(tuple(r) for r in pair_counts_bounded(df, "b", "i").collect())
    assert a == b
    sets = {}
    for bk, it in rows:
        sets.setdefault(bk, set()).add(it)
    assert sum(c for _, _, c in a) == sum(len(s) * (len(s) - 1) // 2 for s in sets.values())
