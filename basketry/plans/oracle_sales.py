"""DuckDB oracle SQL for the star-schema sales jobs.

Stated the direct way (separate aggregates joined, IN subqueries, datediff),
independent of the one-pass Spark plans.
"""

from __future__ import annotations


def M(c: str) -> str:
    return f"CAST({c} AS DECIMAL(15,2))"


NET = f"{M('l.l_extendedprice')} * (1 - {M('l.l_discount')})"
PROFIT = (f"({M('l.l_extendedprice')} - {M('l.l_extendedprice')} * {M('l.l_tax')}"
          f" - {M('l.l_extendedprice')} * {M('l.l_discount')}) + {NET}")


def _growth_sql(measure: str, year: int) -> str:
    def side(ch: str) -> str:
        return f"""SELECT cust,
                 sum(CASE WHEN yr = {year} THEN m ELSE 0 END) AS f,
                 sum(CASE WHEN yr = {year + 1} THEN m ELSE 0 END) AS s
          FROM x WHERE ch = '{ch}' GROUP BY cust
          HAVING sum(CASE WHEN yr = {year} THEN m ELSE 0 END) > 0"""
    return f"""x AS (
      SELECT o.o_custkey AS cust, year(o.o_orderdate) AS yr, l.l_linestatus AS ch, {measure} AS m
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      WHERE year(o.o_orderdate) BETWEEN {year} AND {year + 1}),
    st AS ({side('F')}),
    wb AS ({side('O')})"""


SQL = {
    "q06_channel_shift": f"""
    WITH {_growth_sql(PROFIT, 1996)}
    SELECT CAST(CAST(CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) AS DECIMAL(15,1)) AS DOUBLE) AS web_sales_increase_ratio,
           c.c_custkey, c.c_name, c.c_mktsegment, c.c_nationkey
    FROM st JOIN wb ON st.cust = wb.cust JOIN customer c ON c.c_custkey = wb.cust
    WHERE CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) > CAST(st.s AS DOUBLE) / CAST(st.f AS DOUBLE)
    ORDER BY CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) DESC, c.c_custkey LIMIT 100""",

    "q07_pricey_states": """
    WITH cat AS (SELECT p_type, sum(CAST(p_retailprice AS DECIMAL(15,2))) AS s, count(*) AS n
                 FROM part GROUP BY p_type),
    pricey AS (SELECT p.p_partkey FROM part p JOIN cat ON p.p_type = cat.p_type
               WHERE CAST(p.p_retailprice AS DECIMAL(15,2)) * cat.n > cat.s * CAST(1.03 AS DECIMAL(10,4)))
    SELECT n.n_name AS ca_state, count(*) AS cnt
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         JOIN customer c ON o.o_custkey = c.c_custkey
         JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE l.l_partkey IN (SELECT p_partkey FROM pricey) AND year(o.o_orderdate) = 1997
      AND n.n_name IS NOT NULL
    GROUP BY n.n_name HAVING count(*) >= 10
    ORDER BY cnt DESC, ca_state LIMIT 10""",

    "q09_segment_quantity": f"""
    SELECT CAST(sum(l.l_quantity) AS BIGINT) AS total_quantity
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE year(o.o_orderdate) = 1997
      AND ((c.c_mktsegment = 'AUTOMOBILE' AND l.l_extendedprice BETWEEN 1000 AND 30000)
        OR (c.c_mktsegment = 'BUILDING' AND l.l_extendedprice BETWEEN 5000 AND 40000)
        OR (c.c_mktsegment = 'MACHINERY' AND l.l_extendedprice BETWEEN 10000 AND 50000))
      AND ((c.c_nationkey IN (0, 5, 10) AND {NET} BETWEEN 0 AND 20000)
        OR (c.c_nationkey IN (1, 6, 11) AND {NET} BETWEEN 15000 AND 30000)
        OR (c.c_nationkey IN (2, 7, 12) AND {NET} BETWEEN 5000 AND 25000))""",

    "q13_yoy_growth": f"""
    WITH {_growth_sql(NET, 1996)}
    SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
           CAST(CAST(CAST(st.s AS DOUBLE) / CAST(st.f AS DOUBLE) AS DECIMAL(15,2)) AS DOUBLE) AS store_sales_increase_ratio,
           CAST(CAST(CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) AS DECIMAL(15,2)) AS DOUBLE) AS web_sales_increase_ratio
    FROM st JOIN wb ON st.cust = wb.cust JOIN customer c ON c.c_custkey = wb.cust
    WHERE CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) > CAST(st.s AS DOUBLE) / CAST(st.f AS DOUBLE)
    ORDER BY CAST(wb.s AS DOUBLE) / CAST(wb.f AS DOUBLE) DESC, c.c_custkey LIMIT 100""",

    "q16_price_change_sales": f"""
    WITH r AS (SELECT l.l_orderkey AS r_ok, l.l_linenumber AS r_ln, {NET} AS refund
               FROM lineitem l WHERE l.l_returnflag = 'R'),
    x AS (SELECT n.n_name, p.p_type, CAST(o.o_orderdate AS DATE) AS d,
                 {NET} - coalesce(r.refund, 0) AS v
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
               LEFT JOIN r ON l.l_orderkey = r.r_ok AND l.l_linenumber = r.r_ln
               JOIN supplier s ON l.l_suppkey = s.s_suppkey
               JOIN nation n ON s.s_nationkey = n.n_nationkey
               JOIN part p ON l.l_partkey = p.p_partkey
          WHERE datediff('day', DATE '1997-06-20', CAST(o.o_orderdate AS DATE)) BETWEEN -30 AND 30)
    SELECT n_name AS w_state, p_type AS i_item_id,
           CAST(sum(CASE WHEN d < DATE '1997-06-20' THEN v ELSE 0 END) AS DOUBLE) AS sales_before,
           CAST(sum(CASE WHEN d >= DATE '1997-06-20' THEN v ELSE 0 END) AS DOUBLE) AS sales_after
    FROM x GROUP BY n_name, p_type ORDER BY w_state, i_item_id LIMIT 100""",

    "q17_promo_ratio": f"""
    WITH x AS (SELECT {NET} AS v, {M('l.l_discount')} >= CAST(0.05 AS DECIMAL(15,2)) AS promo
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
               WHERE year(o.o_orderdate) = 1997 AND month(o.o_orderdate) = 12),
    p AS (SELECT sum(v) AS promotions FROM x WHERE promo),
    t AS (SELECT sum(v) AS total FROM x)
    SELECT CAST(p.promotions AS DOUBLE) AS promotions, CAST(t.total AS DOUBLE) AS total,
           CAST(p.promotions AS DOUBLE) / CAST(t.total AS DOUBLE) * 100.0 AS promo_percent
    FROM p, t""",

    "q21_return_rebuy": """
    WITH x AS (SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_returnflag,
                      l.l_linestatus, l.l_shipdate, o.o_custkey, o.o_orderdate
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
    sold AS (SELECT l_orderkey AS ticket, l_partkey AS item, o_custkey AS cust, l_suppkey AS store,
                    l_quantity AS ss_qty
             FROM x WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 1),
    ret AS (SELECT l_orderkey AS ticket, l_partkey AS item, o_custkey AS cust, l_quantity AS sr_qty
            FROM x WHERE l_returnflag = 'R' AND year(l_shipdate) = 1996
                     AND month(l_shipdate) BETWEEN 1 AND 7),
    reb AS (SELECT l_partkey AS item, o_custkey AS cust, l_quantity AS ws_qty
            FROM x WHERE l_linestatus = 'O' AND year(o_orderdate) BETWEEN 1996 AND 1998)
    SELECT p.p_partkey, p.p_name, s.s_suppkey, s.s_name,
           CAST(sum(sold.ss_qty) AS BIGINT) AS store_sales_quantity,
           CAST(sum(ret.sr_qty) AS BIGINT) AS store_returns_quantity,
           CAST(sum(reb.ws_qty) AS BIGINT) AS web_sales_quantity
    FROM ret JOIN reb ON ret.item = reb.item AND ret.cust = reb.cust
         JOIN sold ON sold.ticket = ret.ticket AND sold.item = ret.item AND sold.cust = ret.cust
         JOIN part p ON p.p_partkey = sold.item
         JOIN supplier s ON s.s_suppkey = sold.store
    GROUP BY p.p_partkey, p.p_name, s.s_suppkey, s.s_name
    ORDER BY p.p_partkey, p.p_name, s.s_suppkey, s.s_name LIMIT 100""",

    "q22_inventory_change": """
    WITH x AS (SELECT s.s_name, p.p_type, CAST(l.l_shipdate AS DATE) AS d, l.l_quantity AS q
               FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                    JOIN supplier s ON l.l_suppkey = s.s_suppkey
               WHERE datediff('day', DATE '1997-09-05', CAST(l.l_shipdate AS DATE)) BETWEEN -30 AND 30),
    g AS (SELECT s_name, p_type,
                 sum(CASE WHEN d < DATE '1997-09-05' THEN q ELSE 0 END) AS b,
                 sum(CASE WHEN d >= DATE '1997-09-05' THEN q ELSE 0 END) AS a
          FROM x GROUP BY s_name, p_type)
    SELECT s_name AS w_warehouse_name, p_type AS i_item_id,
           CAST(b AS BIGINT) AS inv_before, CAST(a AS BIGINT) AS inv_after
    FROM g WHERE b > 0 AND a / b >= 2.0 / 3.0 AND a / b <= 3.0 / 2.0
    ORDER BY w_warehouse_name, i_item_id LIMIT 100""",
}
