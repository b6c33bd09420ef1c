"""DuckDB oracle SQL for the ML feature tables."""

from __future__ import annotations

from basketry.plans.oracle_sales import NET

_CATS = ",\n           ".join(
    f"CAST(sum(CASE WHEN floor(item / 10) = {k} THEN 1 ELSE 0 END) AS BIGINT) AS clicks_in_{k}"
    for k in range(10))
_BRANDS = ",\n           ".join(
    f"CAST(count(CASE WHEN p.p_brand = 'Brand#{i}' THEN 1 END) AS DOUBLE) AS id{i}"
    for i in range(1, 16))

SQL = {
    "q05_interest_features": f"""
    WITH c AS (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item
               FROM events WHERE user_id IS NOT NULL),
    u AS (SELECT user_id,
           CAST(sum(CASE WHEN floor(item / 10) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS clicks_in_category,
           {_CATS}
          FROM c WHERE item IS NOT NULL GROUP BY user_id)
    SELECT u.*, CASE WHEN cu.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS college_education,
           CASE WHEN cu.c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS male
    FROM u JOIN customer cu ON u.user_id = cu.c_custkey""",

    "q20_return_features": f"""
    WITH x AS (SELECT o.o_custkey AS cust, l.l_orderkey AS ok, {NET} AS money,
                      l.l_returnflag = 'R' AS ret
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
    ord AS (SELECT cust, count(DISTINCT ok) AS orders_count, count(*) AS orders_items,
                   sum(money) AS orders_money FROM x GROUP BY cust),
    rt AS (SELECT cust, count(DISTINCT ok) AS returns_count, count(*) AS returns_items,
                  sum(money) AS returns_money FROM x WHERE ret GROUP BY cust)
    SELECT ord.cust AS user_sk,
           round(coalesce(CAST(rt.returns_count AS DOUBLE) / nullif(CAST(ord.orders_count AS DOUBLE), 0), 0.0), 7) AS order_ratio,
           round(coalesce(CAST(rt.returns_items AS DOUBLE) / nullif(CAST(ord.orders_items AS DOUBLE), 0), 0.0), 7) AS items_ratio,
           round(coalesce(CAST(rt.returns_money AS DOUBLE) / nullif(CAST(ord.orders_money AS DOUBLE), 0), 0.0), 7) AS monetary_ratio,
           CAST(coalesce(rt.returns_count, 0) AS DOUBLE) AS frequency
    FROM ord LEFT JOIN rt ON ord.cust = rt.cust""",

    "q25_rfm_features": f"""
    WITH x AS (SELECT o.o_custkey AS cust, l.l_orderkey AS ok, l.l_linestatus AS ch,
                      CAST(o.o_orderdate AS DATE) AS d, {NET} AS money
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
               WHERE CAST(o.o_orderdate AS DATE) > DATE '2000-01-01' AND o.o_custkey IS NOT NULL),
    store AS (SELECT cust, count(DISTINCT ok) AS frequency, max(d) AS most_recent_date,
                     sum(money) AS amount FROM x WHERE ch = 'F' GROUP BY cust),
    web AS (SELECT cust, count(DISTINCT ok) AS frequency, max(d) AS most_recent_date,
                   sum(money) AS amount FROM x WHERE ch = 'O' GROUP BY cust),
    u AS (SELECT * FROM store UNION ALL SELECT * FROM web)
    SELECT cust AS cid,
           CASE WHEN datediff('day', max(most_recent_date), DATE '2001-08-01') < 60
                THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
             AS recency,
           CAST(sum(frequency) AS DOUBLE) AS frequency, CAST(sum(amount) AS DOUBLE) AS totalspend
    FROM u GROUP BY cust""",

    "q26_book_club_features": f"""
    SELECT o.o_custkey AS cid,
           {_BRANDS}
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
         JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE p.p_type = 'ECONOMY' AND o.o_custkey IS NOT NULL
    GROUP BY o.o_custkey HAVING count(*) > 5 ORDER BY cid""",

    "q28_review_split": """
    SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}
