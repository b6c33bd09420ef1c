"""WARC not-modified revisits resolved to the latest earlier full response.

The as-of join sorts all captures by range partitions of (canonical URL, time):
a URL with a third of all captures simply spans many partitions. Inside a
partition a window finds the last response before each revisit; the last
response of each (partition, URL) is carried on to later partitions of the
same URL, through a window that sees one row per partition and URL.

The revisit is then checked against that response's validators, and its
permitted headers replace the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketry.llm.common import saved

# Headers that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not name a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and ``www.``, path without
    closing slashes, sorted query without tracking parameters; no scheme, no
    fragment. Other strings than URLs lose their fragment only."""
    host = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    key = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), key).otherwise(F.regexp_replace(url, "#.*$", ""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal, the first."""
    entries = F.coalesce(F.map_entries(headers), F.map_entries(F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(
        names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), 1)["value"]))


def merged_headers(response: Column, revisit: Column, permitted=PERMITTED) -> Column:
    allowed = F.array(*[F.lit(p) for p in permitted])
    new = F.map_filter(_lower_keys(revisit), lambda k, v: F.array_contains(allowed, k))
    old = F.map_filter(_lower_keys(response), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def _outcome(r: str) -> Column:
    """Validators in order of strength: entity tags (weak comparison), then
    modification times; payload digests must not contradict."""
    def weak(c):
        return F.regexp_replace(c, "^W/", "")
    etags = F.col("etag").isNotNull() & F.col(f"{r}.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col(f"{r}.last_modified").isNotNull()
    digests = F.col("digest").isNotNull() & F.col(f"{r}.digest").isNotNull()
    same = F.when(etags, weak(F.col("etag")) == weak(F.col(f"{r}.etag"))).when(
        dates, F.col("last_modified") == F.col(f"{r}.last_modified")).when(
        digests, F.col("digest") == F.col(f"{r}.digest"))
    clash = digests & (F.col("digest") != F.col(f"{r}.digest"))
    return (F.when(F.col(r).isNull(), "no_response").when(clash | ~F.coalesce(same, F.lit(True)), "validator_mismatch")
            .when(same.isNull(), "unverified").otherwise("resolved"))


def resolve(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """``captures``: ``record_id`` long, ``url``, ``ts`` (orderable), ``kind``
    ('response' or 'revisit'; others are ignored), ``status`` int, ``etag``,
    ``last_modified``, ``digest`` strings, ``headers`` map.

    One row per revisit: ``record_id, url_key, refers_to, outcome, status,
    headers``. The response is the latest with the same canonical URL and an
    earlier time (not the same time); of several, the one with the largest
    ``record_id``. Outcomes: ``resolved``; ``unverified`` (no validator in
    common); ``validator_mismatch`` and ``no_response``, which keep status null
    and the revisit's own headers. A null URL or time finds no response. Null
    headers count as none. Repeated rows count each.
    """
    spark = captures.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = captures.where("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.col("kind") == "response",
        "status", "etag", "last_modified", "digest", "headers").toDF(
        "record_id", "url_key", "ts", "full", "status", "etag", "last_modified", "digest", "headers")
    # Revisits of a time stand before responses of that time: not earlier.
    ordered = c.where("url_key is not null and ts is not null").repartitionByRange(n, "url_key", "ts", "full", "record_id")
    ordered = saved(ordered.withColumn("part", F.spark_partition_id()), "captures")
    resp = F.when(F.col("full"), F.struct("record_id", "status", "etag", "last_modified", "digest", "headers"))
    ordered = ordered.withColumn("resp", resp)
    before = W.partitionBy("part", "url_key").orderBy("ts", "full", "record_id").rowsBetween(W.unboundedPreceding, -1)
    within = ordered.withColumn("near", F.last("resp", ignorenulls=True).over(before))
    last = ordered.groupBy("part", "url_key").agg(
        F.expr("max_by(resp, struct(ts, record_id)) FILTER (WHERE full)").alias("resp"))
    carried = last.withColumn("far", F.last("resp", ignorenulls=True).over(
        W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("resp")
    found = within.where("not full").join(carried, ["part", "url_key"]).withColumn("r", F.coalesce("near", "far"))
    none = c.where("(url_key is null or ts is null) and not full").withColumn(
        "r", F.lit(None).cast(found.schema["r"].dataType))
    cols = ["record_id", "url_key", "etag", "last_modified", "digest", "headers", "r"]
    out = found.select(*cols).unionByName(none.select(*cols)).withColumn("outcome", _outcome("r"))
    good = F.col("outcome").isin("resolved", "unverified")
    return out.select(
        "record_id", "url_key", F.when(good, F.col("r.record_id")).alias("refers_to"), "outcome",
        F.when(good, F.col("r.status")).alias("status"),
        F.when(good, merged_headers(F.col("r.headers"), F.col("headers"))).otherwise(_lower_keys(F.col("headers"))).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: visits a day apart to each page, three
    to five of them, forty more to every 97th. Every tenth page is reached by an
    address of one portal, which is one URL but for its tracking parameter.

    The first visit is a full response (a revisit for every 13th page), the third
    a changed one for every third page, the others revisits. Every 7th page has
    no entity tags; of those the even ones have modification times, stale at the
    fourth visit to every fifth page. Every 11th page's fourth visit carries a
    stale entity tag. Revisits of page 1 of 4 carry the payload's digest, the
    second visits of page 3 of 4 one that contradicts it. The payloads stay
    behind."""
    page, k = F.col("page_id"), F.col("k")
    url = F.when(page % 10 == 0, F.concat(F.lit("https://portal.example/?ref="), page.cast("string"))).otherwise(F.col("url"))
    p = pages.select("page_id", url.alias("url"), F.md5(F.coalesce("html", F.lit(""))).alias("d"),
                     F.length(F.coalesce("html", F.lit(""))).alias("n"))
    visits = F.lit(2) + F.pmod(page, F.lit(3)) + F.when(page % 97 == 0, 40).otherwise(0)
    v = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), visits.cast("long"))))
    changed = (page % 3 == 0) & (k >= 2)
    full = ((k == 0) & (page % 13 != 0)) | ((k == 2) & (page % 3 == 0))
    v = v.withColumn("full", full).withColumn("d", F.when(changed, F.reverse("d")).otherwise(F.col("d")))
    tag = F.when(page % 7 == 0, F.lit(None)).when(
        (page % 11 == 0) & (k == 3), F.lit('"stale"')).otherwise(F.concat(F.lit('"'), F.substring("d", 1, 16), F.lit('"')))
    modified = F.when((page % 7 == 0) & (page % 2 == 0), F.when(
        (page % 5 == 0) & (k == 3), F.lit("stale")).otherwise(F.concat(F.lit("m"), F.substring("d", 1, 8))))
    seen = F.when(F.col("full") | (page % 4 == 1), F.col("d")).when((page % 4 == 3) & (k == 1), F.upper("d"))
    v = v.withColumns({"etag": tag, "last_modified": modified, "digest": seen,
                       "ts": F.lit(1704067200) + k * 86400 + page * 7919 % 86400})
    stamp = F.col("ts").cast("string")
    own = F.when(F.col("full"), F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("Content-Type", "Content-Length", "Server", "Date", "Cache-Control", "ETag")]),
        F.array(F.lit("text/html"), F.col("n").cast("string"), F.lit("origin"), stamp, F.lit("max-age=60"), "etag"))).otherwise(
        F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("Content-Length", "Date", "Cache-Control", "Expires", "X-Cache")]),
            F.array(F.lit("0"), stamp, F.concat(F.lit("max-age="), F.col("k").cast("string")), (F.col("ts") + 60).cast("string"), F.lit("HIT"))))
    return v.select(
        (F.col("page_id") * 64 + F.col("k")).alias("record_id"), "url", "ts",
        F.when(F.col("full"), "response").otherwise("revisit").alias("kind"),
        F.when(F.col("full"), 200).otherwise(304).alias("status"), "etag",
        "last_modified", "digest",
        F.map_filter(own, lambda k, x: x.isNotNull()).alias("headers"))
