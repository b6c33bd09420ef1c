import random
import zlib

from basketry.llm.toxicity import Savings, toxicity, train_dictionaries

SYL = "ka lo mi tre sun ver at en on ing ti sha re or ou de la ch ie mo".split()
BAD = ["grumph", "vlekko", "snarz"]


def corpus(n=900, seed=6):
    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choice(SYL) for _ in range(rnd.choice([2, 3, 3, 4])))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.choice([30, 80, 200]))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(BAD) + rnd.choice(["", "", "en", "ing"])
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_documents_are_caught(spark, docs_of):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "## 11"), (5003, "kalomi " * 20_000), (None, "kalo"), (7, docs[7][1])]
    lab = spark.createDataFrame(labels + [(3, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    got = toxicity(docs_of(docs + odd), lab).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.03 * len(held)
    assert not any(by[i].predicted for i in (5000, 5001, 5002, 5003))


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark, docs_of):
    docs, labels = corpus(400)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    one = toxicity(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    two = toxicity(docs_of([(d, t, "zz", "other") for d, t in docs]), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in one} == {r.doc_id: r.score for r in two}


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity(docs_of([(1, "a"), (2, None)]), none).collect()] == [(0.0, 0)] * 2
    every = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(docs_of([(1, "a"), (2, None)]), every).collect()} == {(1.0, 1)}
    assert toxicity(docs_of([]).limit(0), every).count() == 0


def test_dictionaries_differ_in_telling_beginnings_only():
    docs, labels = corpus()
    pair = train_dictionaries([docs[i][1].encode() for i, y in labels if y], [docs[i][1].encode() for i, y in labels if not y])
    assert len(pair[0]) == len(pair[1]) > 0
    s = Savings(*pair)
    assert all(s.of(w.encode()) >= 0.25 for w in BAD)
    ordinary = [s.of(w.encode()) for _, t in docs[:40] for w in t.split() if not w.startswith(tuple(BAD))]
    assert sum(x >= 0.3 for x in ordinary) <= 0.01 * len(ordinary)


def masked(n=900, seed=8):
    """Toxic by short words and words with digits and signs inside."""
    docs, labels = corpus(n, seed)
    rnd = random.Random(seed)
    swap = {b: m for b, m in zip(BAD, ["zq", "v1#kk*", "9%x"])}
    out = []
    for i, t in docs:
        out.append((i, " ".join(next((m for b, m in swap.items() if w.startswith(b)), w) for w in t.split())))
    rnd.shuffle(out)
    return out, labels


def test_short_and_masked_words_tell(spark, docs_of):
    docs, labels = masked()
    by = {r.doc_id: r for r in toxicity(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(p for p, y in held if y) >= 0.6 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.05 * len(held)


def test_passages_after_20000_characters_are_learned(spark, docs_of):
    docs, labels = corpus(400)
    toxic = dict(labels)
    rnd = random.Random(4)

    def prose(n):
        return " ".join("".join(rnd.choice(SYL) for _ in range(3)) for _ in range(n))
    # Toxic words stand behind 20,000 characters only.
    docs = [(i, prose(3500)[:21_000] + " " + t) for i, t in docs[:300]]
    lab = spark.createDataFrame([(i, toxic[i]) for i, _ in docs], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity(docs_of(docs), lab).collect()}
    held = [(by[i].score, toxic[i]) for i, _ in docs if by[i].held_out]
    mean = [sum(p for p, y in held if y == side) / sum(y == side for _, y in held) for side in (0, 1)]
    assert mean[1] > mean[0] + 0.3


def test_dictionaries_hold_all_telling_words():
    rnd = random.Random(3)
    ends = ["".join(rnd.choice(SYL) for _ in range(4)) for _ in range(1000)]
    toxic = [" ".join(["grumph" + e for e in ends[i::20]]).encode() for i in range(20)]
    ordinary = [" ".join("".join(rnd.choice(SYL) for _ in range(3)) for _ in range(60)).encode() for _ in range(60)]
    first = train_dictionaries(toxic, ordinary)[0].decode("utf-16-le")
    assert all(f" grumph{e} " in first for e in ends)


def test_columns_with_clashing_names(spark, docs_of):
    docs, labels = corpus(200)
    plain = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = docs_of(docs).selectExpr("*", "1 AS toxic", "2 AS tox", "3 AS weight", "4 AS words", "5 AS score", "6 AS top")
    one = {r.doc_id: r.score for r in toxicity(df, plain.selectExpr("*", "1 AS text", "2 AS quality", "3 AS for_dict")).collect()}
    assert one == {r.doc_id: r.score for r in toxicity(docs_of(docs), plain).collect()}
