import random

import __spark_entry__ as E
import corpus_pipeline as P
from basketry.llm.common import saved

SYL = {"xa": "ka lo mi ta ne sa ro".split(), "xb": "streng wolf zwarp knit brot".split()}


def documents(docs_of):
    rnd = random.Random(3)

    def prose(lang, n):
        return " ".join("".join(rnd.choice(SYL[lang]) for _ in range(3)) for _ in range(n))
    rows = []
    for i in range(120):
        lang = rnd.choice(["xa", "xb"])
        rows.append((i, prose(lang, rnd.randrange(5, 120)), lang, f"s{rnd.randrange(5)}"))
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 1), rows[i][2], "s1") for i in range(20)]  # equal but for white space
    rows += [(300, rows[0][1] + " extra", "xa", "s0")]
    long = prose("xb", 200)
    rows += [(400, long, "xb", "s2"), (401, long.rsplit(" ", 1)[0], "xb", "s3")]  # near copies
    rows += [(500, None, None, None), (501, "", "xa", "s0"), (502, "## 12", "xb", "s4")]  # no language
    rows += [(None, prose("xa", 30), "xa", None)]
    return docs_of(rows).selectExpr("*", "1 AS rid", "2 AS kept")


def test_stages(spark, docs_of):
    docs = saved(documents(docs_of), "test")
    before = None
    for name, stage in P.STAGES:
        out = saved(stage(spark, docs, "unused"), "test")
        ids = [r[0] for r in out.select("doc_id").collect()]
        if name != "packing":
            assert out.columns == P.COLUMNS
        if name == "language ID":
            assert not {500, 501, 502} & set(ids) and len(ids) == 144
        if name == "exact dedup":
            assert not set(range(200, 220)) & set(ids) and len(ids) == 124
        if name == "n-gram Jaccard join":
            assert 400 in ids and 401 not in ids and None in ids
            before = {r.doc_id: r.text for r in out.collect()}
        if name == "source mixing":
            for r in out.collect():
                assert r.text == before[r.doc_id] or set(r.text.split()) <= set(before[r.doc_id].split())
            words = sum(len(r.text.split()) for r in out.collect())
            assert abs(words - 1.5 * sum(len(t.split()) for t in before.values())) <= 10
        if name == "packing":
            assert len(ids) == docs.count()
        docs = out


def test_empty_documents(spark, docs_of):
    docs = docs_of([]).limit(0)
    for _, stage in P.STAGES:
        docs = saved(stage(spark, docs, "unused"), "test")
        assert docs.count() == 0


def test_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
