"""DuckDB oracle SQL for the review text jobs."""

from __future__ import annotations

from basketry.operators.text import DEFAULT_LEXICON
from basketry.plans.oracle_sales import NET

LEX = "(VALUES " + ", ".join(
    f"('{w}', '{pol}')" for pol, ws in DEFAULT_LEXICON.items() for w in ws) + ") AS lex(word, sentiment)"


def _sentiment(src: str, ids: str, only: str | None = None) -> str:
    """Polar (sentence, word) rows of a CTE ``src`` with columns ids..., text."""
    cond = f"WHERE lex.sentiment = '{only}'" if only else ""
    return f"""
    sent AS (SELECT {ids}, unnest(regexp_extract_all(lower(text), '[^.!?]+', 0)) AS review_sentence
             FROM {src}),
    words AS (SELECT {ids}, review_sentence,
                     unnest(list_distinct(regexp_extract_all(review_sentence, '\\p{{L}}+', 0))) AS word
              FROM sent)
    SELECT {ids}, review_sentence, lex.sentiment AS sentiment, words.word AS sentiment_word
    FROM words JOIN {LEX} ON words.word = lex.word {cond}"""


SQL = {
    "q10_sentiment": """
    WITH r AS (SELECT doc_id AS item_sk, text FROM documents),""" + _sentiment(
        "r", "item_sk"),

    "q18_declining_store_reviews": f"""
    WITH daily AS (
      SELECT l.l_suppkey AS store,
             CAST(datediff('day', DATE '1997-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS x,
             CAST(sum({NET}) AS DOUBLE) AS y
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      WHERE CAST(o.o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
      GROUP BY 1, 2),
    reg AS (SELECT store, (count(*) * sum(x * y) - sum(x) * sum(y))
                            / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0) AS slope
            FROM daily GROUP BY store),
    names AS (SELECT b.item_id AS store, lower(b.text) AS nm FROM benchmark b
              WHERE b.item_id IN (SELECT store FROM reg WHERE slope <= 0)
                AND b.text IS NOT NULL AND length(b.text) > 0),
    hits AS (SELECT DISTINCT n.store, d.doc_id, d.text FROM documents d
             JOIN names n ON contains(lower(d.text), n.nm)),""" + _sentiment(
        "hits", "store, doc_id", "NEG"),

    "q19_returned_both": """
    WITH r AS (SELECT l_partkey, l_quantity, l_linestatus FROM lineitem
               WHERE l_returnflag = 'R'
                 AND floor(datediff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) / 7) IN (
                   SELECT floor(datediff('day', DATE '1900-01-01', make_date(1997, m, 5 + m)) / 7)
                   FROM (SELECT unnest(range(1, 13)) AS m))),
    sr AS (SELECT l_partkey, sum(l_quantity) AS q FROM r WHERE l_linestatus = 'F'
           GROUP BY l_partkey HAVING sum(l_quantity) > 0),
    wr AS (SELECT l_partkey, sum(l_quantity) AS q FROM r WHERE l_linestatus = 'O'
           GROUP BY l_partkey HAVING sum(l_quantity) > 0),
    items AS (SELECT sr.l_partkey FROM sr JOIN wr ON sr.l_partkey = wr.l_partkey
              WHERE abs(sr.q - wr.q) / ((sr.q + wr.q) / 2.0) <= 0.1),
    d AS (SELECT doc_id AS item_sk, text FROM documents WHERE doc_id IN (SELECT l_partkey FROM items)),"""
    + _sentiment("d", "item_sk", "NEG"),

    "q27_competitors": """
    WITH names AS (SELECT DISTINCT regexp_extract(lower(text), '^\\p{L}+', 0) AS name FROM benchmark),
    dict AS (SELECT name FROM names WHERE length(name) >= 5),
    sent AS (SELECT doc_id AS review_sk, doc_id AS item_sk,
                    unnest(regexp_extract_all(lower(text), '[^.!?]+', 0)) AS review_sentence
             FROM documents),
    words AS (SELECT review_sk, item_sk, review_sentence,
                     unnest(list_distinct(regexp_extract_all(review_sentence, '\\p{L}+', 0))) AS word
              FROM sent)
    SELECT review_sk, item_sk, dict.name AS company_name, review_sentence
    FROM words JOIN dict ON words.word = dict.name""",
}
