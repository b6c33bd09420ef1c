"""DuckDB oracle SQL for the statistics jobs."""

from __future__ import annotations

from basketry.plans.oracle_sales import NET

SQL = {
    "q11_review_corr": """
    WITH buyers AS (SELECT DISTINCT user_id FROM events
                    WHERE event_type = 'purchase'
                      AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
    pu AS (SELECT user_id, count(*) AS n,
                  CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) / count(value) AS a
           FROM events WHERE user_id IS NOT NULL AND user_id IN (SELECT user_id FROM buyers)
           GROUP BY user_id)
    SELECT round(corr(n, a), 9) AS review_corr FROM pu""",

    "q14_am_pm_ratio": """
    WITH x AS (SELECT hour(ts) AS h FROM events WHERE value BETWEEN 1.0 AND 20.0),
    c AS (SELECT count(CASE WHEN h BETWEEN 7 AND 8 THEN 1 END) AS am_count,
                 count(CASE WHEN h BETWEEN 19 AND 20 THEN 1 END) AS pm_count FROM x)
    SELECT am_count, pm_count,
           CAST(CAST(CAST(am_count AS DOUBLE) / nullif(CAST(pm_count AS DOUBLE), 0) AS DECIMAL(15,4)) AS DOUBLE)
             AS am_pm_ratio
    FROM c""",

    "q15_declining_category": f"""
    WITH daily AS (
      SELECT p.p_type AS cat,
             CAST(datediff('day', DATE '1997-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS x,
             CAST(sum({NET}) AS DOUBLE) AS y
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           JOIN part p ON l.l_partkey = p.p_partkey
      WHERE l.l_suppkey = 10 AND p.p_type IS NOT NULL
        AND CAST(o.o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
      GROUP BY 1, 2),
    r AS (SELECT cat, count(*) AS n, sum(x) AS sx, sum(y) AS sy,
                 (count(*) * sum(x * y) - sum(x) * sum(y))
                   / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0) AS slope
          FROM daily GROUP BY cat)
    SELECT cat, round(slope, 7) AS slope, round((sy - slope * sx) / n, 7) AS intercept
    FROM r WHERE slope <= 0 ORDER BY cat""",

    "q23_inventory_cov": """
    WITH x AS (SELECT s.s_nationkey AS warehouse, p.p_type AS item,
                      CAST(month(l.l_shipdate) AS INTEGER) AS d_moy, l.l_quantity AS q
               FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                    JOIN part p ON l.l_partkey = p.p_partkey
               WHERE year(l.l_shipdate) = 1997 AND month(l.l_shipdate) BETWEEN 1 AND 2),
    g AS (SELECT warehouse, item, d_moy, CAST(stddev_samp(q) AS DECIMAL(15,5)) AS sd,
                 CAST(avg(q) AS DECIMAL(15,5)) AS mu
          FROM x GROUP BY warehouse, item, d_moy),
    c AS (SELECT warehouse, item, d_moy,
                 CAST(CAST(sd AS DOUBLE) / CAST(mu AS DOUBLE) AS DECIMAL(15,5)) AS cov
          FROM g WHERE mu > 0 AND CAST(sd AS DOUBLE) / CAST(mu AS DOUBLE) >= 0.6)
    SELECT a.warehouse, a.item, a.d_moy, CAST(a.cov AS DOUBLE) AS cov, b.d_moy AS d_moy_consecutive,
           CAST(b.cov AS DOUBLE) AS cov_consecutive
    FROM c a JOIN c b ON a.warehouse = b.warehouse AND a.item = b.item
                     AND a.d_moy = 1 AND b.d_moy = 2
    ORDER BY a.warehouse, a.item""",

    "q24_price_elasticity": """
    WITH p AS (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'),
    ch AS (SELECT p.p_partkey AS item, p.p_partkey * 2 + r.k AS imp_sk,
                  DATE '1995-06-01' + CAST((p.p_partkey * 37 + r.k * 401) % 2000 AS INTEGER) AS s,
                  CAST(30 + (p.p_partkey + r.k * 7) % 60 AS INTEGER) AS len,
                  CAST((p.p_partkey * 13 + r.k * 5) % 21 - 10 AS DOUBLE) / 100.0 AS price_change
           FROM p CROSS JOIN (SELECT range AS k FROM range(0, 2)) r),
    sales AS (SELECT l.l_partkey AS item, CAST(o.o_orderdate AS DATE) AS sold,
                     l.l_quantity AS qty, l.l_linestatus AS chn
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
    w AS (SELECT ch.item, ch.imp_sk, ch.price_change,
                 coalesce(sum(CASE WHEN sales.sold >= ch.s AND sales.chn = 'F' THEN qty ELSE 0 END), 0) AS af,
                 coalesce(sum(CASE WHEN sales.sold >= ch.s AND sales.chn = 'O' THEN qty ELSE 0 END), 0) AS ao,
                 coalesce(sum(CASE WHEN sales.sold < ch.s AND sales.chn = 'F' THEN qty ELSE 0 END), 0) AS bf,
                 coalesce(sum(CASE WHEN sales.sold < ch.s AND sales.chn = 'O' THEN qty ELSE 0 END), 0) AS bo
          FROM ch LEFT JOIN sales ON sales.item = ch.item AND sales.sold >= ch.s - ch.len
                                  AND sales.sold < ch.s + ch.len
          GROUP BY ch.item, ch.imp_sk, ch.price_change)
    SELECT item AS i_item_sk,
           CAST(CAST(avg((af + ao - bf - bo) / nullif((bf + bo) * price_change, 0)) AS DECIMAL(15,7)) AS DOUBLE)
             AS cross_price_elasticity
    FROM w GROUP BY item""",
}
