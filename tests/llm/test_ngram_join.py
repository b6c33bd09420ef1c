import random
import re

import numpy as np
import pytest

from basketry.llm import ngram_join as N
from basketry.llm.components import components
from basketry.llm.ngram_join import ngram_components, one_of_each
from basketry.llm.shingles import shingle_sets


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), d if d is None else find(d)) for d, s in sets), key=str)


def corpus(seed, n=60):
    """Near copies at every distance, edited copies of edited copies, common
    passages, very short texts."""
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    common = [rnd.choice(words) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "ONE  two"),
            (1007, "one two three"), (None, "one two three"), (1008, "one two three four")]
    base = [[rnd.choice(words) for _ in range(rnd.choice([8, 9, 10, 11, 40, 200]))] for _ in range(6)]
    for i in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if rnd.random() < 0.3:
            t = t + common
        rows.append((i, " ".join(t)))
        if rnd.random() < 0.2:
            base[rnd.randrange(6)] = t
    return rows


@pytest.mark.parametrize("seed,k,num", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_matches_brute_force(docs_of, seed, k, num):
    rows = corpus(seed)
    got = sorted((tuple(r) for r in ngram_components(docs_of(rows), k, num, 100).collect()), key=str)
    assert got == brute(rows, k, num, 100)


def test_large_tiles_come_again(docs_of, monkeypatch):
    """One long chain of near copies: neighbours link, the hub links with few."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rnd = random.Random(8)
    t = ["w%d" % rnd.randrange(10_000) for _ in range(120)]
    rows = []
    for i in range(80):
        t = list(t)
        t[(7 * i) % 120] = "x%d" % i
        rows.append((i, " ".join(t)))
    rnd.shuffle(rows)
    got = sorted((tuple(r) for r in ngram_components(docs_of(rows), 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


def test_repeated_ids_are_one_node(docs_of):
    a, b = "a b c d e f", "g h i j k l"
    got = {tuple(r) for r in ngram_components(docs_of([(5, a), (5, b), (2, a), (3, b), (9, a), (9, a)]), 3, 90, 100).collect()}
    assert got == {(5, 4, 2), (2, 4, 2), (3, 4, 2), (9, 4, 2)}


def test_empty_table_and_what_stays(docs_of):
    assert ngram_components(docs_of([]).limit(0)).count() == 0
    kept = one_of_each(docs_of([(2, "a b c d e f"), (1, "a b c d e f"), (3, "z"), (None, "q"), (4, None)]))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d e f"), ("3", "z"), ("4", None), ("None", "q")]


def test_linked_sets_share_a_key_and_pass_the_bound():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for n in (3, 9, 10, 15, 40, 300, 1500):
            for _ in range(20):
                x = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
                drop = int(rng.integers(0, n * (den - num) // den + 2))
                y = np.concatenate([x[drop:], rng.integers(0, 2 ** 64, int(rng.integers(0, drop + 1)), dtype=np.uint64)])
                x, y = np.unique(x), np.unique(y)
                if not len(y) or np.array_equal(x, y) or not N.linked(x, y, num, den):
                    continue
                assert np.intersect1d(N.tile_keys(x, num, den), N.tile_keys(y, num, den)).size
                a, b = N.bitmap(x), N.bitmap(y)
                w = min(len(a), len(b))
                assert N.may_link(len(x), N.fold(a, w), len(y), N.fold(b, w), num, den)


def test_shingles_match_words():
    texts = ["A b c d", "a B  c d", "b c d", "", "x", "x y", "xy", "a b c d a b c d", "é ü ß", "É ü ß"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = shingle_sets(data, offs, 3)
    want = [shingles(t, 3) for t in texts]
    for i in range(len(texts)):
        assert len(got[i]) == len(want[i])
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_elements_come_last_and_linked_sets_still_share_a_key():
    rng = np.random.default_rng(6)
    passage = np.unique(rng.integers(0, 2 ** 64, 60, dtype=np.uint64))
    common = (passage, np.full(len(passage), 5, np.int8))
    for n in (60, 100, 400):
        own = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
        x = np.unique(np.concatenate([own, passage]))
        first = N.prefix(x, 80, 100, common)
        assert len(first) == len(x) - -(-80 * len(x) // 100) + 1
        assert not np.intersect1d(first, passage).size  # the passage makes no tile
        for drop in range(0, n // 8, max(1, n // 40)):
            y = np.unique(np.concatenate([own[drop:], passage, rng.integers(0, 2 ** 64, drop // 2, dtype=np.uint64)]))
            if N.linked(x, y, 80, 100):
                assert np.intersect1d(N.tile_keys(x, 80, 100, common), N.tile_keys(y, 80, 100, common)).size


def test_sampled_order_changes_no_result(docs_of, monkeypatch):
    rows = corpus(11, 40)
    want = brute(rows, 5, 80, 100)
    monkeypatch.setattr(N, "COMMON", 3)
    assert sorted((tuple(r) for r in ngram_components(docs_of(rows), 5, 80, 100).collect()), key=str) == want


def test_very_long_texts_and_clashing_columns(docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long.replace("w500 ", "x ")), (3, " ".join(f"v{i}" for i in range(60_000))), (4, None)]
    df = docs_of(rows).selectExpr("*", "1 AS rep", "2 AS fp", "3 AS bits", "4 AS key")
    got = sorted(tuple(r) for r in ngram_components(df, 5, 80, 100).collect())
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 1), (3, 3), (4, 4)] and got[0][1] == 59_996
    kept = one_of_each(df, 5, 80, 100)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
