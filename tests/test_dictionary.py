"""Dictionaries met by hash: names of several words, rare anchors, a learned lexicon."""

import random
import re

from pyspark.sql import functions as F

from basketry.operators.dictionary import HashFilter
from basketry.operators.joins import contains_candidates, join_contains
from basketry.operators.text import extract_polarity, find_company, learn_lexicon, sentences

SF = "/root/testdata/sf0.1"
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def names_in(text, names):
    """Distinct names by a scan from the left, the longest at each place."""
    by = {" ".join(TOKEN.findall(n.lower())): n.lower() for n in names}
    for s in re.findall(r"[^.!?]+", text.lower()):
        t, k, out = TOKEN.findall(s), 0, []
        while k < len(t):
            n = next((n for n in range(len(t) - k, 0, -1) if " ".join(t[k:k + n]) in by), 0)
            if n:
                out.append(by[" ".join(t[k:k + n])])
            k += n or 1
        yield from ((x, s) for x in dict.fromkeys(out))


def test_names_of_several_words(spark):
    texts = ["New York is not new yorkshire. York new. NEW  york, new york city!", "at&t and AT & T; x-2000 or x 2000", "",
             "new. york", "york", "The New York City Times and New York Times"]
    names = ["new york", "New York City", "york", "AT&T", "x-2000", "city times", "--", "12", "york times"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, t string")
    df = spark.createDataFrame([(n,) for n in [*names, None, "", " "]], "name string")
    got = sorted((r.id, r.company_name, r.review_sentence) for r in find_company(docs, ["id"], "t", df).collect())
    assert got == sorted((i, n, s) for i, t in enumerate(texts) for n, s in names_in(t, names))
    assert (0, "new york", "new york is not new yorkshire") in got and (5, "new york city", texts[5].lower()) in got


def test_names_against_a_scan(spark):
    rnd = random.Random(4)
    voc = ["a", "b", "c", "dd", "é", "7", "-"]
    texts = ["".join(rnd.choice(voc) + rnd.choice([" ", " ", "  ", ". ", ", "]) for _ in range(rnd.randrange(40))) for _ in range(150)]
    for longest in (1, 4):
        names = {" ".join(rnd.choice(voc[:5]) for _ in range(rnd.randrange(1, longest + 1))) for _ in range(30)}
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
        df = spark.createDataFrame([(n,) for n in names], "name string")
        got = sorted((r.id, r.company_name, r.review_sentence) for r in find_company(docs, ["id"], "t", df).collect())
        assert got == sorted((i, n, s) for i, t in enumerate(texts) for n, s in names_in(t, names))


def test_filter_has_no_false_negatives(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = HashFilter(df, "h")
    assert df.where(f.may_hold(F.col("h"))).count() == 5000
    assert spark.range(10_000, 60_000).select(F.xxhash64("id").alias("h")).where(f.may_hold(F.col("h"))).count() < 5000


def test_hundred_thousand_names(spark):
    rnd = random.Random(1)
    syl = "ka lo mi ta ne sa ro ti".split()
    names = list({" ".join("".join(rnd.choice(syl) for _ in range(rnd.randrange(3, 6))) for _ in range(rnd.randrange(4, 7)))
                  for _ in range(100_000)})
    common = " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(40))
    texts = [(i, f"{common} {rnd.choice(names)} {common}" if i % 3 else common) for i in range(3000)]
    docs = spark.createDataFrame(texts, "id long, t string")
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hits = join_contains(docs, "id", "t", df, "n")
    assert hits.select("id").distinct().count() == 2000
    found = hits.count()
    # rows that leave the texts for the join: little more than the pairs found
    assert contains_candidates(docs, "id", "t", df.withColumnRenamed("n", "_n")).count() <= 2 * found


def test_learned_lexicon_tells_held_out_reviews_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    fit = lab.where("doc_id % 5 <> 0").select("doc_id", F.expr("toxic = 1").alias("neg"))
    lex = learn_lexicon(docs.join(fit, "doc_id", "left"), "text", "neg").collect()
    neg, pos = ({r.word for r in lex if r.sentiment == s} for s in ("NEG", "POS"))
    assert neg
    held = docs.join(lab.where("doc_id % 5 = 0"), "doc_id").collect()

    def share(r):
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        return (sum(w in neg for w in words) - sum(w in pos for w in words)) / max(1, len(words))
    toxic = [share(r) for r in held if r.toxic]
    clean = [share(r) for r in held if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert wins > 0.65, wins  # area under the curve


def test_negation_scope(spark):
    lex = spark.createDataFrame([("good", "POS"), ("bad", "NEG")], "word string, sentiment string")
    docs = spark.createDataFrame([(1, "not a good day, good. never bad good! no one here is good"), (2, None), (3, "")], "id long, t string")
    got = sorted((r.review_sentence.strip(), r.sentiment_word, r.sentiment, r.hits)
                 for r in extract_polarity(docs, ["id"], "t", lex, scope=2).collect())
    assert got == [("never bad good", "bad", "POS", 1), ("never bad good", "good", "NEG", 1), ("no one here is good", "good", "POS", 1),
                   ("not a good day, good", "good", "NEG", 1), ("not a good day, good", "good", "POS", 1)]


def test_sentences_without_text(spark):
    docs = spark.createDataFrame([(1, None), (2, "...")], "id long, t string")
    assert sentences(docs, "t", ["id"]).count() == 0


def test_sentences_are_not_shuffled_to_be_counted(spark):
    lex = spark.createDataFrame([("good", "POS"), ("BAD", "NEG"), ("odd", "POS"), ("odd", "NEG"), ("none", None), ("+", "POS")],
                                "word string, sentiment string")
    docs = spark.createDataFrame([(1, "good good not good goodly"), (1, "good good not good goodly"), (2, "odd not odd no no odd"),
                                  (3, "none not none"), (4, "never bad. \t. + not + goo d"), (None, "bad")], "id long, t string")
    out = extract_polarity(docs, ["id"], "t", lex, scope=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "review_sentence" not in "".join(
        x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    got = sorted(map(str, ((r.id, r.sentiment_word, r.sentiment, r.hits) for r in out.collect())))
    assert got == sorted(map(str, 2 * [(1, "good", "POS", 2), (1, "good", "NEG", 1)] + [
        (2, "odd", "POS", 3), (2, "odd", "NEG", 3), (3, "none", None, 1), (3, "none", "POS", 1),
        (4, "bad", "POS", 1), (4, "+", "POS", 1), (4, "+", "NEG", 1), (None, "bad", "NEG", 1)]))
