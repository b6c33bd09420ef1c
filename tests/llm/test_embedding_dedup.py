import numpy as np
import pytest

from basketry.llm import embedding_dedup as E
from basketry.llm.embedding_dedup import near_vectors


def brute(rows, threshold=0.98):
    ids = list(range(len(rows)))
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def ok(r):
        v = r[1]
        return r[2] is not None and v and None not in v and np.isfinite(v).all() and any(v)
    links = [0] * len(rows)
    for i in ids:
        for j in ids[:i]:
            a, b = rows[i], rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in ids:
        v = rows[i][0]
        low.setdefault(find(i), []).append(v)
    comp = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((rows[i][0], links[i], comp[find(i)], rows[i][0] == comp[find(i)]) for i in ids), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 0.0], 1), (9, [1.0, inf, 0.0], 1), (10, [1.0, None, 0.0], 1), (11, [1.0, 0.0, 0.0], None),
            (12, [1.0, 0.0], 1), (None, [1.0, 0.1, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1), (14, [1e30, 0.0, 0.0], 1)]
    got = sorted((tuple(r) for r in near_vectors(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert near_vectors(table(spark, rows).limit(0)).count() == 0
    extra = table(spark, rows, "double").selectExpr("*", "1 AS rep", "2 AS keys", "3 AS n_links")
    assert sorted((tuple(r) for r in near_vectors(extra).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_recall_and_precision(spark, monkeypatch, block):
    """Clusters at the threshold and a crowd of hundreds in one bucket."""
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 32))
    x = [b + rng.standard_normal(32) * s for b in base for s in (0.0, 0.05, 0.13)]
    x += [base[0] + rng.standard_normal(32) * 0.02 for _ in range(150)]
    x += [base[1]] * 40
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 2)) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in near_vectors(table(spark, rows)).collect()}
    want = brute(rows)
    found, true = sum(r.n_links for r in got.values()), sum(w[1] for w in want)
    assert found >= 0.97 * true
    assert all(got[w[0]].n_links <= w[1] for w in want)
    assert np.mean([got[w[0]].component_id == w[2] for w in want]) > 0.97


def test_codes_are_balanced():
    x = np.random.default_rng(0).standard_normal((2000, 64))
    mean, (p,) = E.learn(x / np.linalg.norm(x, axis=1, keepdims=True), 1)
    share = ((x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ p >= 0).mean(0)
    assert (abs(share - 0.5) < 0.06).all()
