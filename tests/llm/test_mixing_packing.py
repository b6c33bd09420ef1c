import itertools

import numpy as np
import pytest

from basketry.llm.mixing import mix, mixed_rows, schedule
from basketry.llm.packing import optimal_bounds, pack


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    pool, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = pool / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not full:
            return {**out, **{s: level * w[s] for s in free}}
        for s in full:
            out[s] = 2.0 * sizes[s]
            pool -= out[s]
        free -= full
    return out


def test_taken_words_meet_targets(docs_of):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), "en", ["a", "b", "c", "d", None, "Z"][int(rng.choice(6, p=[.4, .2, .1, .1, .1, .1]))])
            for i in range(500)]
    rows += [(900, None, "en", "a"), (901, "", "en", "b"), (902, "x " * 9000, "en", "c"), (1, "y y", "en", "a"), (None, "q q q", "en", None)]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    got, pieces = mix(docs_of(rows))
    got = got.toPandas()
    assert len(got) == len(rows)
    for s, t in want.items():
        g = got[got.source.isna()] if s is None else got[got.source == s]
        assert g.target.to_numpy() == pytest.approx(t, abs=1e-5)
        assert abs(g.taken.sum() - t) <= 1
        assert (g.source_size == sizes[s]).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = mix(docs_of(rows))[0].toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    p = pieces.toPandas()
    assert (p.hi - p.lo).sum() == got.taken.sum()


def test_schedule_spreads_sources(spark):
    plan = spark.createDataFrame([("sa", 500, 0), ("sb", 300, 500), ("sc", 200, 800)], "skey string, slots long, lo long")
    s = schedule(plan, 1000).toPandas()
    assert s.groupby("skey")["rank"].apply(lambda r: sorted(r) == list(range(len(r)))).all()
    assert s.skey.value_counts().to_dict() == {"sa": 500, "sb": 300, "sc": 200}
    early = s[s.slot < 100].skey.value_counts()
    assert abs(early["sa"] - 50) <= 4 and abs(early["sb"] - 30) <= 4 and abs(early["sc"] - 20) <= 4


def test_mix_without_rows_or_words(docs_of):
    assert mix(docs_of([]).limit(0))[0].count() == 0
    got = mix(docs_of([(1, None), (2, "")]))[0].collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(60, 9, replace=False)) + 1
    counts = rng.integers(1, 30, 9)
    for k in (1, 2, 3, 4, 9, 20):
        def padding(bounds):
            b = np.array(sorted(bounds))
            return sum(c * (b[np.searchsorted(b, x)] - x) for x, c in zip(lengths, counts))
        best = min(padding([*c, lengths[-1]]) for r in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], r))
        assert padding(optimal_bounds(lengths, counts, k)) == best
        assert len(optimal_bounds(lengths, counts, k)) <= k


def test_packing_fills_batches(docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(0, 120, 300))] + [(900, None), (901, "w " * 5000), (5, "a b")]
    got = pack(docs_of(rows), buckets=5, budget=1000).toPandas()
    assert len(got) == len(rows)
    assert sorted(got.n_tokens) == sorted(len((t or "").split()) for _, t in rows)
    assert (got.padding == got.bucket_len - got.n_tokens).all() and (got.padding >= 0).all()
    for (b,), g in got.groupby(["bucket"]):
        per = max(1, 1000 // max(1, g.bucket_len.iloc[0]))
        assert sorted(g["batch"] * per + g.slot) == list(range(len(g)))
        assert g.slot.max() < per
    assert pack(docs_of([]).limit(0)).count() == 0


def test_first_slots_spread_every_source_over_the_mix(spark, docs_of):
    """The schedule reaches the result: by first slot, any stretch of the mix holds
    the sources in the shares of their targets."""
    rows, _ = mix(docs_of([(i, "w " * 64, "en", f"s{i % 3}") for i in range(900)]))
    got = [(r.first_slot, r.source) for r in rows.where("first_slot is not null").collect()]
    assert len({s for s, _ in got}) == len(got) > 600
    first = sorted(got)[:200]  # the first pass through each source
    share = {s: sum(x == s for _, x in first) / 200 for s in ("s0", "s1", "s2")}
    want = {r.source: r.target for r in rows.select("source", "target").distinct().collect()}
    total = sum(want.values())
    assert all(abs(share[s] - want[s] / total) < 0.05 for s in share), (share, want)


def test_columns_with_clashing_names(docs_of):
    df = docs_of([(1, "a b", "en", "s"), (2, None, "en", None), (1, "a b", "en", "s")]).selectExpr(
        "*", "1 AS rid", "2 AS bucket", "3 AS cell", "4 AS h", "5 AS size", "6 AS target", "7 AS off", "8 AS slot", "9 AS n_tokens", "10 AS skey")
    assert sorted((r.doc_id, r.n_tokens) for r in pack(df).collect()) == [(1, 2), (1, 2), (2, 0)]
    rows, _ = mix(df)
    assert sorted((r.doc_id, r["size"], r.source_size) for r in rows.collect()) == [(1, 2, 4), (1, 2, 4), (2, 0, 0)]
    mixed = mixed_rows(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} == {1}
