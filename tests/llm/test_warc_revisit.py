import random

import pytest
from pyspark.sql import functions as F

from basketry.llm.warc_revisit import canonical_url, captures_of, resolve

SCHEMA = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/", "https://example.com:443/a?utm_source=x#top", "//EXAMPLE.com/a?ref=1&fbclid=2", "https://u:p@example.com/a"]
    other = ["http://example.com/A", "http://example.com/a?b=1", "http://m.example.com/a"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, "http://e.com/?b=2&a=1&", "not a url#x", None, ""]], "u string")
    got = {r.u: r.k for r in df.select("u", canonical_url(F.col("u")).alias("k")).collect()}
    assert {got[u] for u in same} == {"example.com/a"}
    assert [got[u] for u in other] == ["example.com/A", "example.com/a?b=1", "m.example.com/a"]
    assert got["http://e.com/?b=2&a=1&"] == "e.com?a=1&b=2" and got["not a url#x"] == "not a url" and got[None] is None and got[""] == ""


def brute(rows):
    out = []
    for i, url, ts, kind, _, etag, _, digest, _ in rows:
        if kind != "revisit":
            continue
        full = [r for r in rows if r[3] == "response" and r[1] == url and url is not None and ts is not None and r[2] is not None and r[2] < ts]
        r = max(full, key=lambda r: (r[2], r[0])) if full else None
        if r is None:
            what = "no_response"
        elif digest and r[7] and digest != r[7]:
            what = "validator_mismatch"
        elif etag and r[5]:
            what = "resolved" if etag.removeprefix("W/") == r[5].removeprefix("W/") else "validator_mismatch"
        else:
            what = "resolved" if digest and r[7] else "unverified"
        out.append((i, r[0] if what in ("resolved", "unverified") else None, what))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 13])
def test_matches_brute_force(spark, partitions):
    """Half of all captures on one URL; equal times; nulls."""
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["x://h/hot"] * 4 + ["x://h/a", "x://h/b", "x://h/c", None]), rnd.choice([None] + list(range(40))),
             rnd.choice(["response", "revisit", "revisit", "request"]), 200, rnd.choice([None, '"a"', 'W/"a"', '"b"']), None,
             rnd.choice([None, None, "d1", "d2"]), None) for i in range(600)]
    got = resolve(spark.createDataFrame(rows, SCHEMA), partitions).collect()
    assert sorted(((r.record_id, r.refers_to, r.outcome) for r in got), key=str) == brute(rows)


def test_headers_merge(spark):
    rows = [(1, "x://h/p", 1, "response", 200, '"t"', None, "d", {"ETag": '"t"', "Content-Type": "text/html", "DATE": "1", "date": "0", "Content-Length": "9"}),
            (2, "x://h/p", 2, "revisit", 304, 'W/"t"', None, None, {"Date": "2", "Content-Length": "0", "expires": "9"}),
            (3, "x://h/p", 3, "revisit", 304, '"u"', None, None, {"Date": "3", "X": "1"}),
            (4, "x://h/q", 3, "revisit", 304, '"u"', None, None, None)]
    got = {r.record_id: r for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].outcome == "resolved" and got[2].status == 200
    assert got[2].headers == {"etag": '"t"', "content-type": "text/html", "date": "2", "content-length": "9", "expires": "9"}
    assert got[3].outcome == "validator_mismatch" and got[3].headers == {"date": "3", "x": "1"} and got[3].refers_to is None
    assert got[4].outcome == "no_response" and got[4].headers == {}


def test_empty_tables_and_odd_pages(spark):
    assert resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, "http://a.b/", ""), (13, "http://a.b/", "x")], "page_id long, url string, html string")
    assert resolve(captures_of(pages)).count() > 0


def test_derived_captures_reach_every_validator(spark):
    """Entity tags, times, digests and their contradictions all decide, and one
    URL holds far more captures than any other."""
    c = captures_of(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    revisits = c.where("kind = 'revisit'")
    assert revisits.where("last_modified is not null and etag is null").count() > 10
    assert revisits.where("digest is not null").count() > 10 and revisits.where("last_modified = 'stale'").count() > 0
    outcomes = {r.outcome: r["count"] for r in resolve(c).groupBy("outcome").count().collect()}
    assert min(outcomes.get(k, 0) for k in ("resolved", "unverified", "validator_mismatch", "no_response")) > 3
    sizes = sorted(r["count"] for r in c.groupBy(canonical_url(F.col("url"))).count().collect())
    assert sizes[-1] > 20 * sizes[len(sizes) // 2]


def test_carried_names_do_not_clash(spark):
    rows = [(1, "x://h/p", 1, "response", 200, '"t"', None, "d", {}), (2, "x://h/p", 2, "revisit", 304, '"t"', None, None, {})]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS resp", "3 AS url_key", "4 AS full", "5 AS r")
    assert [(r.refers_to, r.outcome) for r in resolve(df).collect()] == [(1, "resolved")]
