import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import language_id as L
from basketry.llm.language_id import accepted_documents, fit, identify, page_evidence

VOCAB = {"xa": "kalo miso taru neko sabi roku hana".split(), "xb": "streng wolf zwarp knit brott schal".split(), "xc": "éuou aiée ôteau œuil êtré".split()}


def text(rnd, lang, n=40):
    return " ".join(rnd.choice(VOCAB[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang), lang) for i, lang in enumerate(list(VOCAB) * 60)] + [(None, None, "xa"), (900, "", "xb"), (901, "q", None)]
    return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy_and_edge_rows(spark, model):
    rnd = random.Random(2)
    rows = [(f"u{i}", text(rnd, lang, 12), "h.example.com", "example.com", "com", None, lang) for i, lang in enumerate(list(VOCAB) * 30)]
    odd = [("n1", None, None, None, None, None, ""), ("n2", "", "h.example.com", "", "", "xa", ""), ("n3", "123 ### 45", None, None, None, None, ""),
           ("n4", "kalo " * 30_000, None, None, None, None, "xa")]
    df = spark.createDataFrame(rows + odd + odd[:1], "id string, text string, host string, domain string, suffix string, declared string, want string")
    got = identify(df, model).collect()
    assert len(got) == len(rows) + 5
    assert sum(r.language == r.want for r in got if r.want) >= 0.98 * (len(rows) + 1)
    assert not any(r.accepted for r in got if not r.want)
    assert all(r.accepted for r in got if r.want)


def test_evidence_beside_the_text_decides_short_texts(spark, model):
    rnd = random.Random(3)
    rows = [(i, text(rnd, "xa"), "a.example.xa", "example.xa", "xa", "xa") for i in range(60)]
    rows += [(100 + i, text(rnd, "xb"), "b.example.xb", "example.xb", "xb", "xb") for i in range(60)]
    rows += [(901, "q", "a.example.xa", "example.xa", "xa", "xa"), (902, "q", "b.example.xb", "example.xb", "xb", "xb")]
    df = spark.createDataFrame(rows, "id long, text string, host string, domain string, suffix string, declared string")
    got = {r.id: r.language for r in identify(df, model).collect() if r.id > 900}
    assert got == {901: "xa", 902: "xb"}


def test_no_labels_no_rows(spark, model):
    df = spark.createDataFrame([("t", None, None, None, None)], "text string, host string, domain string, suffix string, declared string")
    assert [r.accepted for r in identify(df, ([], model[1][:0])).collect()] == [False]
    assert identify(df.limit(0), model).count() == 0
    pages = spark.createDataFrame([(1, "https://www.A.example.org:80/x?q#f", '<html LANG="de-AT"><p>t'), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in page_evidence(pages).collect()}
    assert (got[1].host, got[1].domain, got[1].suffix, got[1].declared) == ("www.a.example.org", "example.org", "org", "de")
    assert got[2].host == "" and got[2].declared == ""


OTHERS = {
    "russian": "съешь же ещё этих мягких французских булок да выпей чаю и приходи завтра в гости к нам",
    "greek": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία και πηγαίνω σπίτι μου αργά το βράδυ με τους φίλους",
    "japanese": "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえて",
    "noise": "xqzvk bwrtp mnghj fdsqz lkjhg pqwzx vbnmk trzqp xkcdq wvbgh jklpq zxcvb"}


def test_texts_without_a_labelled_language_are_rejected(spark):
    """On the model of the driver's documents, which all have labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = fit(docs)
    rows = [(k, t * n, None, None, None, None) for k, t in OTHERS.items() for n in (1, 3, 2000)]
    df = spark.createDataFrame(rows, "id string, text string, host string, domain string, suffix string, declared string")
    got = identify(df, real).collect()
    assert [r.id for r in got if r.accepted] == []
    # declared values do not carry them in
    sure = identify(df.withColumn("declared", F.lit("de")).unionByName(docs.limit(300).selectExpr(
        "'doc' AS id", "text", "NULL AS host", "NULL AS domain", "NULL AS suffix", "lang AS declared")), real).collect()
    assert not any(r.accepted for r in sure if r.id != "doc")
    # every document of the table that is text stays
    kept = accepted_documents(docs).count()
    held = docs.where("length(regexp_replace(text, '[^a-zA-Z]', '')) > 0").count()
    assert kept >= 0.995 * held


def test_posterior_equals_a_plain_computation(spark, model):
    """One row's fusion, number by number, from the rows beside it."""
    rnd = random.Random(9)
    rows = [(i, text(rnd, lang, 3), f"h{i % 4}.example.xa", "example.xa", "xa" if i % 2 else None, lang if i % 3 else None)
            for i, lang in enumerate(list(VOCAB) * 8)]
    df = spark.createDataFrame(rows, "id long, text string, host string, domain string, suffix string, declared string")
    got = {r.id: r for r in identify(df, model).collect()}
    langs, table = model
    n = len(langs)

    def ll(t):
        data = np.frombuffer(t.encode(), np.uint8)
        tri, _ = L._trigrams(data, np.array([0, len(data)]))
        return table[:, tri].astype(float).sum(1)

    def soft(x):
        e = np.exp(x - x.max())
        return e / e.sum()
    own = {r[0]: soft(ll(r[1]) * L.TEMPER + np.log([1.0] * n + [L.OTHER * n]))[:-1] for r in rows}
    for r in rows[:6]:
        def beside(k):
            return sum((own[x[0]] for x in rows if x[k] == r[k] and x[0] != r[0]), np.zeros(n))
        every = sum((own[x[0]] for x in rows if x[0] != r[0]), np.zeros(n))
        prior = (every + 1) / (every.sum() + n)
        for k in (3, 2):
            prior = (beside(k) + L.ALPHA * prior) / (beside(k).sum() + L.ALPHA)
        score, none = ll(r[1])[:-1] * L.TEMPER + np.log(prior), ll(r[1])[-1] * L.TEMPER + np.log(L.OTHER)
        for k in (4, 5):
            if r[k] is not None:
                score = score + np.log((beside(k) + 0.5) / (every + 5))
                none += np.log((beside(k).sum() + 0.5) / (every.sum() + 5))
        post = soft(np.append(score, none))[:-1]
        assert got[r[0]].language == langs[post.argmax()] and abs(got[r[0]].confidence - post.max()) < 1e-6


def test_carried_columns_keep_their_names(spark, model):
    df = spark.createDataFrame([("kalo miso taru", "h", "d", "s", "xa", 1, "old", 2.5, "__x")],
                               "text string, host string, domain string, suffix string, declared string, letters int, language string, ll double, __host string")
    r = identify(df, model).collect()[0]
    assert (r.letters, r.ll, r["__host"], r.language) == (1, 2.5, "__x", "xa")
    assert identify(df, ([], model[1][:0])).columns == identify(df, model).columns


def test_rejected_documents_go(docs_of):
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang), lang) for i, lang in enumerate(list(VOCAB) * 40)]
    junk = [(500, None, "xa"), (501, "", "xb"), (502, "12 34", None), (None, "", None), (None, text(rnd, "xa"), None)]
    kept = accepted_documents(docs_of(rows + junk))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted((str(r.doc_id) for r in kept.collect()))
    assert got == sorted([str(i) for i in range(len(rows))] + ["None"])
    assert accepted_documents(docs_of([]).limit(0)).count() == 0
