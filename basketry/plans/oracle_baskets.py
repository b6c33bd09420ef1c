"""DuckDB oracle SQL for the basket and click-path jobs.

Written independently of the Spark plans: plain window functions and
self joins, the way one would state the question in SQL.
"""

from __future__ import annotations


def _clicks_cte(where: str = "TRUE") -> str:
    return f"""c AS (
      SELECT user_id AS u, epoch_us(ts) AS t, event_id, event_type, value,
             TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    cf AS (SELECT * FROM c WHERE {where})"""


def _sessions_cte(timeout_us: int, where: str = "TRUE") -> str:
    return _clicks_cte(where) + f""",
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, event_id) > {timeout_us}
                    THEN 1 ELSE 0 END AS nw FROM cf),
    s AS (SELECT *, 1 + sum(nw) OVER (PARTITION BY u ORDER BY t, event_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sn FROM g)"""


SQL = {
    "q01_sold_together": """
    WITH bi AS (
      SELECT DISTINCT l.l_orderkey AS basket, concat_ws('/', p.p_brand, p.p_type) AS item
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
    SELECT a.item AS item_1, b.item AS item_2, count(*) AS cnt
    FROM bi a JOIN bi b ON a.basket = b.basket AND a.item < b.item
    GROUP BY a.item, b.item HAVING count(*) > 5
    ORDER BY cnt DESC, item_1, item_2 LIMIT 100""",

    "q02_viewed_with_item": f"""
    WITH {_sessions_cte(86400 * 10**6, "item IS NOT NULL")},
    si AS (SELECT DISTINCT u, sn, item FROM s),
    hit AS (SELECT DISTINCT u, sn FROM si WHERE item = 10)
    SELECT si.item AS viewed_item, count(*) AS cnt, CAST(10 AS BIGINT) AS target_item
    FROM si JOIN hit ON si.u = hit.u AND si.sn = hit.sn
    WHERE si.item <> 10
    GROUP BY si.item ORDER BY cnt DESC, viewed_item LIMIT 30""",

    "q03_views_before_buy": f"""
    WITH {_clicks_cte("item IS NOT NULL AND event_type IN ('view', 'purchase')")},
    n AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY u ORDER BY t, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vn FROM cf),
    v AS (SELECT u, vn, t, item FROM n WHERE event_type = 'view'),
    b AS (SELECT u, vn, t, item FROM n WHERE event_type = 'purchase' AND vn > 0)
    SELECT b.item AS purchased_item, v.item AS lastviewed_item, count(*) AS cnt
    FROM b JOIN v ON b.u = v.u AND v.vn BETWEEN b.vn - 4 AND b.vn
                 AND b.t - v.t <= {10 * 86400 * 10**6}
    GROUP BY b.item, v.item
    ORDER BY cnt DESC, purchased_item, lastviewed_item LIMIT 100""",

    "q04_abandoned_carts": f"""
    WITH {_sessions_cte(6 * 3600 * 10**6)},
    a AS (SELECT u, sn, count(*) AS pagecount,
                 max(CASE WHEN event_type = 'click' THEN t END) AS lc,
                 max(CASE WHEN event_type = 'purchase' THEN t END) AS lp
          FROM s GROUP BY u, sn)
    SELECT count(*) AS abandoned_sessions,
           CAST(CAST(sum(pagecount) / count(*) AS DECIMAL(20,1)) AS DOUBLE) AS average_pages
    FROM a WHERE lc IS NOT NULL AND (lp IS NULL OR lp < lc)""",

    "q08_review_effect": f"""
    WITH c AS (
      SELECT user_id AS u, epoch_us(ts) AS t, event_id, event_type, value
      FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
    o AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END)
                      OVER (PARTITION BY u ORDER BY t, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv
          FROM c WHERE u IS NOT NULL),
    hit AS (SELECT DISTINCT event_id FROM o
            WHERE event_type = 'purchase' AND lv IS NOT NULL AND t - lv <= {3 * 86400 * 10**6}),
    sales AS (SELECT c.event_id, CAST(value AS DECIMAL(15,2)) AS amount,
                     hit.event_id IS NOT NULL AS is_hit
              FROM c LEFT JOIN hit ON c.event_id = hit.event_id
              WHERE c.event_type = 'purchase')
    SELECT CAST(coalesce(sum(CASE WHEN is_hit THEN amount END), 0) AS DOUBLE) AS review_sales_amount,
           CAST(sum(amount) - coalesce(sum(CASE WHEN is_hit THEN amount END), 0) AS DOUBLE)
             AS no_review_sales_amount
    FROM sales""",

    "q12_view_then_store": f"""
    WITH {_clicks_cte("floor(item / 10) IN (1, 2)")},
    w AS (SELECT u, t FROM cf WHERE event_type = 'view'
            AND t >= epoch_us(TIMESTAMP '2024-01-01') AND t < epoch_us(TIMESTAMP '2024-01-01') + {10 * 86400 * 10**6}),
    p AS (SELECT u, t FROM cf WHERE event_type = 'purchase'
            AND t >= epoch_us(TIMESTAMP '2024-01-01') AND t < epoch_us(TIMESTAMP '2024-01-01') + {30 * 86400 * 10**6})
    SELECT DISTINCT w.u AS u_id FROM w JOIN p ON w.u = p.u AND w.t < p.t ORDER BY u_id""",

    "q29_bought_together_cat": """
    WITH bi AS (
      SELECT DISTINCT l.l_orderkey AS basket, p.p_type AS item
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type IS NOT NULL)
    SELECT a.item AS category_1, b.item AS category_2, count(*) AS cnt
    FROM bi a JOIN bi b ON a.basket = b.basket AND a.item < b.item
    GROUP BY a.item, b.item ORDER BY cnt DESC, category_1, category_2 LIMIT 100""",

    "q30_viewed_together_cat": f"""
    WITH {_sessions_cte(3600 * 10**6, "event_type IS NOT NULL")},
    bi AS (SELECT DISTINCT u, sn, event_type AS item FROM s)
    SELECT a.item AS category_1, b.item AS category_2, count(*) AS cnt
    FROM bi a JOIN bi b ON a.u = b.u AND a.sn = b.sn AND a.item < b.item
    GROUP BY a.item, b.item ORDER BY cnt DESC, category_1, category_2 LIMIT 100""",
}
