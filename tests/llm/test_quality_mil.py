import random
import zlib

import numpy as np
import pyarrow as pa

from basketry.llm.common import utf8
from basketry.llm.quality_mil import PASSAGE, WIDTH, Attention, passages, quality, scores, train

SYL = "ka lo mi tre sun ver at en on ing ti sha re or ou de la ch ie mo".split()


def corpus(n=700, seed=3):
    """Poor documents hold some passages of junk among good ones."""
    rnd = random.Random(seed)

    def words(k):
        return ["".join(rnd.choice(SYL) for _ in range(rnd.choice([1, 2, 3, 4]))) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        w = words(rnd.choice([20, 90, 300]))
        poor = rnd.random() < 0.25
        if poor:
            k = rnd.randrange(len(w) // 2 + 1)
            n_junk = max(15, len(w) // 3)
            junk = rnd.choice([lambda x: x + "***", lambda x: x.upper() + "!!", lambda x: "| " + x])
            w[k:k + n_junk] = [junk(x) for x in w[k:k + n_junk]]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not poor)))
    return docs, labels


def texts(*t):
    return utf8(pa.array(t))


def test_passages_cover_the_whole_text():
    long = " ".join(f"w{k}" for k in range(PASSAGE * 5 + 1))
    x, bags = passages(*texts("", long, "  \n ", "a b", long))
    assert bags.tolist() == [0, 1, 7, 8, 9, 15] and x.shape == (15, WIDTH)
    assert (x[0] == 0).all()
    alone, one = passages(*texts(long))  # what stands around a text doesn't matter
    assert np.array_equal(x[1:7], alone) and np.array_equal(x[9:], alone)
    tail, _ = passages(*texts(long + " ####"))
    assert not np.array_equal(tail[5], alone[5]) and np.array_equal(tail[:5], alone[:5])


def test_gradient_equals_differences():
    rnd = np.random.default_rng(2)
    bags, y, weight = np.array([0, 1, 4, 9]), np.array([0.0, 1, 1]), np.array([1.0, 2, 0.5])
    x = rnd.normal(size=(9, 6))
    net = Attention({k: v.astype(float) for k, v in Attention.begin(6, rnd).p.items()})

    def loss():
        logit = net.forward(x, bags)[0]
        return float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum() / weight.sum())
    for k, g in net.gradient(x, bags, y, weight).items():
        flat = net.p[k].reshape(-1)
        for j in range(0, flat.size, 7):
            was = flat[j]
            flat[j] = was + 1e-6
            up = loss()
            flat[j] = was - 1e-6
            assert abs((up - loss()) / 2e-6 - g.reshape(-1)[j]) < 1e-6
            flat[j] = was


def test_attention_is_a_weighted_mean_of_each_bag():
    rnd = np.random.default_rng(5)
    x, bags = rnd.normal(size=(7, 6)), np.array([0, 3, 7])
    net = Attention.begin(6, rnd)
    logit, (h, t, s, a, z) = net.forward(x, bags)
    for k, (i, j) in enumerate(zip(bags, bags[1:])):
        e = np.exp((t[i:j] * s[i:j]) @ net.p["w"])
        assert np.allclose(a[i:j], e / e.sum()) and np.allclose(z[k], (a[i:j, None] * h[i:j]).sum(0))
        alone = net.forward(x[i:j], np.array([0, j - i]))[0]
        assert np.allclose(alone[0], logit[k])


def test_held_out_documents(spark, docs_of):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, " \n"), (5003, "kalomi " * 50_000), (None, "kalo"), (7, docs[7][1])]
    lab = spark.createDataFrame(labels + [(3, None), (None, 1), (99_999, 1)], "doc_id long, quality int")
    df = docs_of(docs + odd).withColumnsRenamed({"lang": "score", "source": "passages", "n_chars": "good"})
    got = quality(df, lab).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    # one brute-force score: the bag alone through the trained model
    lone = quality(docs_of([docs[5], *odd, *docs[:5], *docs[6:]]), lab).where("doc_id = 5").first()
    assert abs(lone.score - by[5].score) < 1e-6


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark, docs_of):
    docs, labels = corpus(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one = quality(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    two = quality(docs_of([(d, t, "zz", "other") for d, t in docs]), spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    assert {r.doc_id: round(r.score, 9) for r in one} == {r.doc_id: round(r.score, 9) for r in two}


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality(docs_of([(1, "a"), (2, None)]), none).collect()] == [(0.0, 0)] * 2
    every = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality(docs_of([(1, "a"), (2, None)]), every).collect()} == {(1.0, 1)}
    assert quality(docs_of([]).limit(0), every).count() == 0


def test_training_is_repeatable():
    docs, labels = corpus(120)
    x, bags = passages(*texts(*[t for _, t in docs]))
    parts = [x[a:z] for a, z in zip(bags, bags[1:])]
    y, w = np.array([float(q) for _, q in labels]), np.ones(len(labels))
    a, b = train(parts, y, w), train(parts, y, w)
    assert np.array_equal(scores(a, x, bags), scores(b, x, bags))
