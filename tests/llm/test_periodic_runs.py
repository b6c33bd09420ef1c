import random
import re
import zlib
from hashlib import sha256

import numpy as np

from basketry.llm.periodic_runs import COVER, V, Extensions, collapsed, digests, periodic_runs, planted, runs_of


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[k] == w[k + q] for k in range(len(w) - q)))


def brute_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            e = k
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - k >= max(least, times * q) and smallest_period(w[k:e + q]) == q:
                out[k, e + q] = q
            k = e
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic(rnd, n, letters):
    w = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        a, q = rnd.randrange(n), rnd.randrange(1, 2 + n // 4)
        for i in range(a + q, min(n, a + q * rnd.randrange(2, 8) + rnd.randrange(q))):
            w[i] = w[i - q]
    return w


def test_cover_holds_every_difference():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))


def test_extensions_equal_plain_comparison():
    rnd = random.Random(3)
    for letters, n in ((1, 400), (2, 500), (3, 90), (50, 700)):
        w = np.array([*periodic(rnd, n, letters), letters])
        ext = Extensions(w)
        i = np.array([rnd.randrange(n) for _ in range(3000)])
        j = np.array([rnd.randrange(n + 1) for _ in range(3000)])
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i.tolist(), j.tolist(), ext.of(i, j).tolist()):
            k = 0
            while max(a, b) + k <= n and w[a + k] == w[b + k]:
                k += 1
            assert got == k


def test_runs_equal_brute_force():
    rnd = random.Random(8)
    docs = [periodic(rnd, rnd.randrange(1, 260), rnd.choice([1, 2, 3, 40])) for _ in range(120)] + [[]]
    for times, least in ((3, 24), (2, 5), (4, 1)):
        got = runs_of([np.array(d, np.int64) for d in docs], least, times)
        for d, g in zip(docs, got):
            assert g == brute_runs(d, least, times)


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    text = " ".join(x for k, x in enumerate(w) if k not in dropped)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest(), sha256(text.encode()).hexdigest())


def test_query_columns_equal_brute_force(spark, docs_of):
    rnd = random.Random(9)
    docs = [(i, " ".join(f"w{x}" for x in periodic(rnd, rnd.randrange(1, 200), rnd.choice([2, 30, 400])))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b\x1c " * 30), (None, "x y " * 40), (7, docs[7][1]), (-5, "é " * 60),
             (1004, "one"), (1005, "ab\x0bab\x0cab\r" * 9)]
    df = docs_of(docs).withColumnsRenamed({"lang": "runs", "source": "collapsed", "n_chars": "best"})
    got = digests(periodic_runs(planted(df))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(*d) for d in docs), key=str)
    assert sum(r.n_runs > 0 for r in got) > 15


def test_a_very_long_document(spark, docs_of):
    words = [str(k) for k in range(1000)]
    long = " ".join(words * 150)  # 150,000 words
    r = periodic_runs(docs_of([(1, long), (2, "a " * 100_000)])).orderBy("doc_id").collect()
    assert [(x.start, x.length, x.period) for x in r[0].runs] == [(0, 150_000, 1000)] and r[0].collapsed == " ".join(words)
    assert [(x.start, x.length, x.period) for x in r[1].runs] == [(0, 100_000, 1)] and r[1].collapsed == "a"


def test_collapsed_text_and_empty_table(spark, docs_of):
    assert collapsed([b"a", b"b", b"a", b"b", b"a", b"b", b"c"], [(0, 6, 2)]) == b"a b c"
    assert periodic_runs(docs_of([(1, "a")]).limit(0)).collect() == []
