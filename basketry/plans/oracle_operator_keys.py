"""DuckDB oracle SQL for the operator keys."""

from __future__ import annotations

from basketry.operators.text import NEGATORS, SCOPE
from basketry.plans.oracle_baskets import _clicks_cte, _sessions_cte
from basketry.plans.oracle_sales import M, NET
from basketry.plans.oracle_text import _sentiment

K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
ENGINE = ("list_extract(['homr', 'hos', 'hos_gen', 'hot', 'sparksql'], "
          "CAST(user_id % 5 + 1 AS INTEGER))")
RUNS = f"""runs AS (
      SELECT CAST({K} % 30 + 1 AS INTEGER) AS query,
             CASE WHEN hour(ts) < 12 THEN 'POWER_TEST' ELSE 'THROUGHPUT_TEST' END AS phase,
             CAST(round(value * 1000) AS BIGINT) AS duration_ms,
             strftime(ts, '%Y-%m-%d %H:%M:%S') AS start,
             CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
             coalesce(event_type = 'error', false) AS failed,
             {ENGINE} AS engine
      FROM events)"""
AVG = """SELECT phase, query, count(*) AS repeats,
                CAST(sum(duration_ms) AS DOUBLE) / count(*) AS avg_ms,
                round(CAST(sum(duration_ms) AS DOUBLE) / count(*) / 60000.0, 3) AS avg_minutes
         FROM runs WHERE {where} NOT failed GROUP BY phase, query"""


def _nested_leaf(i: int, item: int = 0) -> str:
    return (f"substr(sha256(concat_ws(':', CAST(o_orderkey AS VARCHAR), '0', '{i}', '{item}')), 1, 20)")


def _nested_field(i: int) -> str:
    """Field i of a nested row, by the rules of FIXTURES.md section 3."""
    if i in (14, 18, 24, 25, 28, 30):
        return f"o_orderkey * {i} AS a{i}"
    if i == 9:
        return "o_orderkey % 2 = 0 AS a9"
    if i in (5, 17, 20, 22):
        return f"{_nested_leaf(i, 1)} || ',' || {_nested_leaf(i, 2)} AS a{i}"
    return f"{_nested_leaf(i)} AS a{i}"


NESTED = f"""SELECT {_nested_leaf(1)} AS a1, o_orderkey % 2 = 0 AS a9,
             o_orderkey * 14 AS a14, o_orderkey * 18 AS a18, o_orderkey * 24 AS a24
      FROM orders"""

MARKET = """ch AS (SELECT p.p_partkey AS item, p.p_partkey * 2 + r.k AS imp_sk,
                  DATE '1995-06-01' + CAST((p.p_partkey * 37 + r.k * 401) % 2000 AS INTEGER) AS s,
                  CAST(30 + (p.p_partkey + r.k * 7) % 60 AS INTEGER) AS len
           FROM part p CROSS JOIN (SELECT range AS k FROM range(0, 2)) r)"""

GROWTH = f"""x AS (SELECT o.o_custkey AS cust, year(o.o_orderdate) AS yr, l.l_linestatus AS ch, {NET} AS m
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
               WHERE year(o.o_orderdate) BETWEEN 1996 AND 1997),
    side AS (SELECT cust, ch, sum(CASE WHEN yr = 1996 THEN m ELSE 0 END) AS f,
                    sum(CASE WHEN yr = 1997 THEN m ELSE 0 END) AS s
             FROM x GROUP BY cust, ch HAVING sum(CASE WHEN yr = 1996 THEN m ELSE 0 END) > 0)"""

SQL = {
    # 2.1
    "scan_columnar": """SELECT l_orderkey, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM lineitem
                        WHERE l_shipdate >= TIMESTAMP '1998-01-01'""",
    "load_delimited": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM lineitem",
    "sink_result_text": """SELECT n.n_name, count(*) AS cnt FROM customer c
                           JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
    "append_refresh": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders",
    "multi_insert": """SELECT d.doc_id, l.quality,
                              CASE WHEN d.doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS target
                       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "ctas_temp": f"""
    WITH y AS (SELECT o.o_custkey, CAST(year(o.o_orderdate) AS INTEGER) AS yr, sum({NET}) AS total
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
    SELECT a.o_custkey AS cust, a.yr, CAST(a.total AS DOUBLE) AS total,
           CAST(b.total AS DOUBLE) AS next_total
    FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.yr = a.yr + 1""",
    "scan_runlog": f"WITH {RUNS} SELECT query, phase, duration_ms, start, status, failed FROM runs",
    "scan_querylog": f"""
    SELECT CAST({K} % 30 + 1 AS VARCHAR) AS query,
           CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS seconds,
           CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS rows
    FROM events""",
    "runs_minutes": f"""WITH {RUNS} SELECT query, phase, duration_ms,
                        ((duration_ms * 1000 + 30000) // 60000) / 1000.0 AS minutes FROM runs""",
    "runs_average": f"WITH {RUNS} " + AVG.format(where=""),
    "runs_compare": f"""
    WITH {RUNS},
    a AS ({AVG.format(where="start < '2024-01-16' AND")}),
    b AS ({AVG.format(where="start >= '2024-01-16' AND")})
    SELECT a.phase, a.query, a.avg_ms AS a_ms, b.avg_ms AS b_ms,
           round(100.0 * (b.avg_ms - a.avg_ms) / nullif(a.avg_ms, 0), 6) AS change_percent
    FROM a JOIN b ON a.phase = b.phase AND a.query = b.query""",
    "runs_failures": f"WITH {RUNS} SELECT phase, query, status, start FROM runs WHERE failed",
    "runs_engines": f"""
    WITH {RUNS}
    SELECT query,
           avg(CASE WHEN engine = 'homr' THEN duration_ms END) AS avg_ms_homr,
           avg(CASE WHEN engine = 'hos' THEN duration_ms END) AS avg_ms_hos,
           avg(CASE WHEN engine = 'hos_gen' THEN duration_ms END) AS avg_ms_hos_gen,
           avg(CASE WHEN engine = 'hot' THEN duration_ms END) AS avg_ms_hot,
           avg(CASE WHEN engine = 'sparksql' THEN duration_ms END) AS avg_ms_sparksql
    FROM runs WHERE NOT failed GROUP BY query""",
    "result_diff": """SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'missing' ELSE 'extra' END AS side, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate
                      FROM lineitem WHERE l_orderkey % 97 = 0 OR l_orderkey % 89 = 0""",
    "gen_nested": "SELECT " + ", ".join(_nested_field(i) for i in range(1, 31)) + " FROM orders",
    "load_nested_text": NESTED,
    "nested_to_columnar": f"""SELECT {_nested_leaf(1)} AS a1, 2 AS a5_items, o_orderkey * 30 AS a30
                             FROM orders""",
    "nested_project": NESTED,

    # 2.2
    "project_expr": f"""
    SELECT l.l_orderkey, l.l_linenumber,
           CAST(CAST((({M('l.l_extendedprice')} - {M('l.l_extendedprice')} * {M('l.l_tax')}
                 - {M('l.l_extendedprice')} * {M('l.l_discount')}) + {NET}) * 0.5 AS DECIMAL(20,5))
             AS DOUBLE) AS profit
    FROM lineitem l""",
    "filter_in_list": """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
                         WHERE l_suppkey IN (3, 7, 11, 19, 42)""",
    "filter_between": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
                         WHERE l_quantity BETWEEN 10 AND 20""",
    "filter_disjunctive": f"""
    SELECT l.l_orderkey, l.l_linenumber
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE ((c.c_mktsegment = 'AUTOMOBILE' AND l.l_extendedprice BETWEEN 1000 AND 30000)
        OR (c.c_mktsegment = 'BUILDING' AND l.l_extendedprice BETWEEN 5000 AND 40000)
        OR (c.c_mktsegment = 'MACHINERY' AND l.l_extendedprice BETWEEN 10000 AND 50000))
      AND ((c.c_nationkey IN (0, 5, 10) AND {NET} BETWEEN 0 AND 20000)
        OR (c.c_nationkey IN (1, 6, 11) AND {NET} BETWEEN 15000 AND 30000)
        OR (c.c_nationkey IN (2, 7, 12) AND {NET} BETWEEN 5000 AND 25000))""",
    "filter_not_null": "SELECT event_id FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL",
    "filter_is_null": """SELECT event_id, event_type FROM events
                         WHERE (CASE WHEN event_type = 'purchase' THEN event_id END) IS NULL""",
    "date_range_filter": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders
                            WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'""",
    "days_around": """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM lineitem
                      WHERE datediff('day', DATE '1997-06-20', CAST(l_shipdate AS DATE)) BETWEEN -30 AND 30""",
    "in_subquery": """SELECT l_orderkey, l_linenumber FROM lineitem
                      WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",

    # 2.3
    "join_inner": """
    SELECT l.l_orderkey, l.l_linenumber, c.c_custkey, n.n_name, r.r_name
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         JOIN customer c ON o.o_custkey = c.c_custkey
         JOIN nation n ON c.c_nationkey = n.n_nationkey
         JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "join_left": f"""
    WITH r AS (SELECT l.l_orderkey AS r_ok, l.l_linenumber AS r_ln, {NET} AS refund
               FROM lineitem l WHERE l.l_returnflag = 'R')
    SELECT l.l_orderkey, l.l_linenumber, CAST(coalesce(r.refund, 0) AS DOUBLE) AS refund
    FROM lineitem l LEFT JOIN r ON l.l_orderkey = r.r_ok AND l.l_linenumber = r.r_ln""",
    "join_left_semi": """SELECT l_orderkey, l_linenumber FROM lineitem
                         WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996)""",
    "join_multi_key": """
    WITH x AS (SELECT l.l_orderkey, l.l_partkey, l.l_quantity, l.l_returnflag, o.o_custkey, o.o_orderdate
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
    sold AS (SELECT l_orderkey AS ticket, l_partkey AS item, o_custkey AS cust, l_quantity AS ss_qty
             FROM x WHERE year(o_orderdate) = 1996),
    ret AS (SELECT l_orderkey AS ticket, l_partkey AS item, o_custkey AS cust, l_quantity AS sr_qty
            FROM x WHERE l_returnflag = 'R')
    SELECT sold.ticket, sold.item, sold.cust, ss_qty, sr_qty
    FROM sold JOIN ret ON sold.ticket = ret.ticket AND sold.item = ret.item AND sold.cust = ret.cust""",
    "join_self": """
    SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM lineitem
    WHERE floor(datediff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) / 7) IN (
      SELECT floor(datediff('day', DATE '1900-01-01', d) / 7)
      FROM (VALUES (DATE '1996-04-15'), (DATE '1997-09-28'), (DATE '1999-02-03')) t(d))""",
    "join_nonequi_residual": f"""
    WITH {GROWTH},
    st AS (SELECT cust, CAST(s AS DOUBLE) / CAST(f AS DOUBLE) AS ratio FROM side WHERE ch = 'F'),
    wb AS (SELECT cust, CAST(s AS DOUBLE) / CAST(f AS DOUBLE) AS ratio FROM side WHERE ch = 'O')
    SELECT st.cust, CAST(CAST(st.ratio AS DECIMAL(15,4)) AS DOUBLE) AS store_ratio,
           CAST(CAST(wb.ratio AS DECIMAL(15,4)) AS DOUBLE) AS web_ratio
    FROM st JOIN wb ON st.cust = wb.cust AND wb.ratio > st.ratio""",
    "join_tolerance": """
    WITH sr AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem
                WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_partkey),
    wr AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem
           WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY l_partkey)
    SELECT sr.l_partkey, sr.q AS sr_item_qty, wr.q AS wr_item_qty
    FROM sr JOIN wr ON sr.l_partkey = wr.l_partkey
    WHERE abs(sr.q - wr.q) / nullif((sr.q + wr.q) / 2.0, 0) <= 0.1""",
    "join_scalar": """
    SELECT * FROM (SELECT count(*) AS all_lines FROM lineitem) a,
                  (SELECT count(*) AS returned_lines, CAST(sum(l_quantity) AS BIGINT) AS returned_quantity
                   FROM lineitem WHERE l_returnflag = 'R') b""",
    "join_contains": """
    SELECT d.doc_id, b.item_id FROM documents d
    JOIN benchmark b ON length(b.text) > 0 AND contains(lower(d.text), lower(b.text))""",
    "join_interval_before_after": f"""
    WITH {MARKET},
    sales AS (SELECT l.l_partkey AS item, CAST(o.o_orderdate AS DATE) AS sold,
                     l.l_quantity AS qty, l.l_linestatus AS chn
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
    SELECT ch.item, ch.imp_sk,
           coalesce(sum(CASE WHEN sales.sold >= ch.s AND sales.chn = 'F' THEN qty ELSE 0 END), 0) AS after_F,
           coalesce(sum(CASE WHEN sales.sold < ch.s AND sales.chn = 'F' THEN qty ELSE 0 END), 0) AS before_F,
           coalesce(sum(CASE WHEN sales.sold >= ch.s AND sales.chn = 'O' THEN qty ELSE 0 END), 0) AS after_O,
           coalesce(sum(CASE WHEN sales.sold < ch.s AND sales.chn = 'O' THEN qty ELSE 0 END), 0) AS before_O
    FROM ch LEFT JOIN sales ON sales.item = ch.item AND sales.sold >= ch.s - ch.len
                            AND sales.sold < ch.s + ch.len
    GROUP BY ch.item, ch.imp_sk""",
    "join_dimension_broadcast": """
    SELECT n.n_name, count(*) AS lines FROM lineitem l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
    GROUP BY n.n_name""",

    # 2.4
    "agg_basic": f"""
    SELECT l_returnflag, l_linestatus, count(*) AS count_order,
           CAST(sum(l_quantity) AS BIGINT) AS sum_qty,
           CAST(sum({M('l_extendedprice')}) AS DOUBLE) AS sum_price,
           CAST(sum({M('l_extendedprice')}) AS DOUBLE) / count(l_extendedprice) AS avg_price,
           max(l_discount) AS max_disc
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "agg_global": f"""SELECT count(*) AS lines, CAST(sum({NET}) AS DOUBLE) AS net,
                             strftime(max(l.l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS last_ship FROM lineitem l""",
    "agg_conditional": f"""
    WITH x AS (SELECT s.s_nationkey, year(o.o_orderdate) AS yr, {NET} AS net
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                    JOIN supplier s ON l.l_suppkey = s.s_suppkey)
    SELECT s_nationkey, """ + ", ".join(
        f"CAST(sum(CASE WHEN yr = {y} THEN net END) AS DOUBLE) AS y{y}" for y in range(1995, 2002))
    + " FROM x GROUP BY s_nationkey",
    "agg_count_distinct": """SELECT o.o_custkey, count(DISTINCT l.l_orderkey) AS orders
                             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                             GROUP BY o.o_custkey""",
    "agg_having": """SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS cnt
                     FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600""",
    "agg_stddev_cov": """
    WITH g AS (SELECT l_suppkey, CAST(stddev_samp(l_quantity) AS DECIMAL(15,5)) AS stdev,
                      CAST(avg(l_quantity) AS DECIMAL(15,5)) AS mean
               FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, CAST(stdev AS DOUBLE) AS stdev, CAST(mean AS DOUBLE) AS mean,
           CAST(CAST(CASE WHEN mean <> 0 THEN CAST(stdev AS DOUBLE) / CAST(mean AS DOUBLE) END
                AS DECIMAL(15,5)) AS DOUBLE) AS cov
    FROM g""",
    "agg_corr": """SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 9) AS corr
                   FROM lineitem GROUP BY l_linestatus""",
    "agg_linreg": f"""
    WITH daily AS (
      SELECT l.l_suppkey AS store,
             CAST(datediff('day', DATE '1997-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS x,
             CAST(sum({NET}) AS DOUBLE) AS y
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      WHERE year(o.o_orderdate) = 1997 GROUP BY 1, 2),
    r AS (SELECT store, count(*) AS n, sum(x) AS sx, sum(y) AS sy,
                 (count(*) * sum(x * y) - sum(x) * sum(y))
                   / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0) AS slope
          FROM daily GROUP BY store)
    SELECT store, round(slope, 6) AS slope, round((sy - slope * sx) / n, 4) AS intercept FROM r""",
    "agg_ratio_of_totals": f"""
    WITH x AS (SELECT s.s_nationkey, {NET} AS net, l.l_returnflag = 'R' AS r
               FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)
    SELECT s_nationkey, CAST(sum(CASE WHEN r THEN net END) AS DOUBLE) AS part,
           CAST(sum(net) AS DOUBLE) AS whole,
           CAST(sum(CASE WHEN r THEN net END) AS DOUBLE) / nullif(CAST(sum(net) AS DOUBLE), 0) * 100.0
             AS percent
    FROM x GROUP BY s_nationkey""",
    "agg_two_level": f"""
    WITH daily AS (SELECT l.l_suppkey, CAST(l.l_shipdate AS DATE) AS day, sum({NET}) AS day_net
                   FROM lineitem l GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS days, CAST(sum(day_net) AS DOUBLE) / count(*) AS avg_day_net,
           CAST(max(day_net) AS DOUBLE) AS max_day_net
    FROM daily GROUP BY l_suppkey""",
    "agg_collect_set": """
    SELECT l.l_orderkey, CAST(count(DISTINCT p.p_type) AS INTEGER) AS n_types,
           array_to_string(list_sort(list(DISTINCT p.p_type)), ',') AS types
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey""",
    "distinct_rows": "SELECT DISTINCT user_id, event_type FROM events",

    # 2.5
    "distribute_sort": "SELECT user_id, epoch_us(ts) AS ts_us, event_id FROM events",
    "sessionize": f"""WITH {_sessions_cte(3600 * 10**6)}
                     SELECT event_id, u AS user_id,
                            CAST(u AS VARCHAR) || '_' || CAST(sn AS VARCHAR) AS session_id FROM s""",
    "last_n_before": f"""
    WITH {_clicks_cte("item IS NOT NULL AND event_type IN ('view', 'purchase')")},
    n AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY u ORDER BY t, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vn FROM cf),
    v AS (SELECT u, vn, t, item FROM n WHERE event_type = 'view'),
    b AS (SELECT u, vn, t, item FROM n WHERE event_type = 'purchase' AND vn > 0)
    SELECT b.item AS purchased_item, v.item AS lastviewed_item
    FROM b JOIN v ON b.u = v.u AND v.vn BETWEEN b.vn - 4 AND b.vn
                 AND b.t - v.t <= {10 * 86400 * 10**6}""",
    "purchase_after_page": f"""
    WITH c AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id, event_type FROM events
               WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    o AS (SELECT *, max(CASE WHEN event_type = 'view' THEN t END)
                      OVER (PARTITION BY u ORDER BY t, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM c)
    SELECT DISTINCT event_id AS sale_id FROM o
    WHERE event_type = 'purchase' AND lv IS NOT NULL AND t - lv <= {3 * 86400 * 10**6}""",
    "abandoned_sessions": f"""
    WITH {_sessions_cte(6 * 3600 * 10**6)},
    a AS (SELECT CAST(u AS VARCHAR) || '_' || CAST(sn AS VARCHAR) AS session_id, count(*) AS pagecount,
                 max(CASE WHEN event_type = 'click' THEN t END) AS lc,
                 max(CASE WHEN event_type = 'purchase' THEN t END) AS lp
          FROM s GROUP BY u, sn)
    SELECT session_id, pagecount FROM a WHERE lc IS NOT NULL AND (lp IS NULL OR lp < lc)""",
    "recency_flag": """
    SELECT o_custkey, CASE WHEN datediff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-01') < 60
                           THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS recency
    FROM orders GROUP BY o_custkey""",

    # 2.6
    "order_global": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_totalprice FROM orders
                       ORDER BY o_orderdate, o_orderkey""",
    "top_k": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
                ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""",

    # 2.7
    "union_all_channels": f"""
    WITH x AS (SELECT o.o_custkey, l.l_orderkey, l.l_linestatus, {NET} AS net
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
    SELECT o_custkey, count(DISTINCT l_orderkey) AS frequency, CAST(sum(net) AS DOUBLE) AS amount,
           'store' AS channel FROM x WHERE l_linestatus = 'F' GROUP BY o_custkey
    UNION ALL
    SELECT o_custkey, count(DISTINCT l_orderkey) AS frequency, CAST(sum(net) AS DOUBLE) AS amount,
           'web' AS channel FROM x WHERE l_linestatus = 'O' GROUP BY o_custkey""",

    # 2.8
    "fn_case_coalesce": """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN 'accepted'
                ELSE 'none' END AS state,
           coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, CAST(0.0 AS DOUBLE)) AS big_discount
    FROM lineitem""",
    "fn_math": """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS qty_dev,
                         round(l_extendedprice / l_quantity, 7) AS unit_price,
                         l_orderkey % 10 AS bucket FROM lineitem""",
    "fn_cast": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty,
                         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS price,
                         CAST(l_linenumber AS DOUBLE) AS line_d FROM lineitem""",
    "fn_date": """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day,
                         CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
                         CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
                         epoch_us(o_orderdate) // 1000000 AS epoch_s FROM orders""",
    "fn_virtual_ts": """SELECT event_id,
                               CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400
                               + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS ts_s FROM events""",
    "fn_string": """SELECT p_partkey, p_brand || ' ' || p_name AS label, lower(p_brand) AS brand_lc,
                           CAST(instr(p_name, 'o') AS INTEGER) AS first_o FROM part""",
    "fn_array": """
    WITH x AS (SELECT p_partkey, list_sort(string_split(p_name, ' ')) AS w FROM part)
    SELECT p_partkey, list_contains(w, 'ring') AS has_ring, CAST(len(w) AS INTEGER) AS n_words,
           unnest(w) AS word FROM x""",
    "build_date_dim": """
    WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
    d AS (SELECT CAST(g AS DATE) AS d_date FROM b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY) t(g))
    SELECT strftime(d_date, '%Y-%m-%d') AS d_date, CAST(datediff('day', DATE '1970-01-01', d_date) AS INTEGER) AS d_date_sk,
           CAST(year(d_date) AS INTEGER) AS d_year, CAST(month(d_date) AS INTEGER) AS d_moy,
           CAST(day(d_date) AS INTEGER) AS d_dom, CAST(quarter(d_date) AS INTEGER) AS d_qoy,
           CAST(floor(datediff('day', DATE '1900-01-01', d_date) / 7) AS INTEGER) AS d_week_seq,
           dayname(d_date) AS d_day_name
    FROM d""",

    # 2.10
    "make_pairs": """
    WITH bi AS (SELECT DISTINCT l.l_orderkey AS basket, p.p_type AS item
                FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type IS NOT NULL)
    SELECT a.basket, a.item AS item_1, b.item AS item_2
    FROM bi a JOIN bi b ON a.basket = b.basket AND a.item < b.item""",
    "pair_counts_parts": """
    WITH bi AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem)
    SELECT x.i AS item_1, y.i AS item_2, count(*) AS cnt FROM bi x JOIN bi y ON x.b = y.b AND x.i < y.i
    GROUP BY 1, 2 HAVING count(*) > 1""",
    "viewed_with_item": f"""
    WITH {_sessions_cte(86400 * 10**6, "item IS NOT NULL")},
    si AS (SELECT DISTINCT CAST(u AS VARCHAR) || '_' || CAST(sn AS VARCHAR) AS session, item FROM s),
    hit AS (SELECT DISTINCT session FROM si WHERE item = 10)
    SELECT si.session, si.item FROM si JOIN hit ON si.session = hit.session WHERE si.item <> 10""",
    "extract_sentiment": "WITH r AS (SELECT doc_id, text FROM documents)," + _sentiment("r", "doc_id"),
    "extract_negative": "WITH r AS (SELECT doc_id, source, text FROM documents)," + _sentiment(
        "r", "doc_id, source", "NEG"),
    "find_company": """
    WITH names AS (SELECT DISTINCT regexp_extract(lower(text), '^\\p{L}+', 0) AS name FROM benchmark),
    dict AS (SELECT name FROM names WHERE length(name) >= 5),
    sent AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^.!?]+', 0)) AS review_sentence
             FROM documents),
    words AS (SELECT doc_id, review_sentence,
                     unnest(list_distinct(regexp_extract_all(review_sentence, '\\p{L}+', 0))) AS word
              FROM sent)
    SELECT doc_id, dict.name AS company_name, review_sentence
    FROM words JOIN dict ON words.word = dict.name""",
}

# The same rules, computed by ordered reducers.
SQL["reduce_using_script"] = SQL["abandoned_sessions"]
SQL["reduce_page_before_sale"] = SQL["purchase_after_page"]
SQL["reduce_last_views"] = SQL["last_n_before"]

TOKENS = r"regexp_extract_all(s, '\p{L}+|\p{N}+|[^\p{L}\p{N}\x09-\x0D\x20]')"
SENT = """sent AS (SELECT doc_id, row_number() OVER () AS k, s FROM (
               SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^.!?]+', 0)) AS s FROM documents))"""

# All windows that are a name; of one place the longest; then, per sentence, a
# scan that takes a match if it begins where the last one has ended.
SQL["find_company_names"] = rf"""
    WITH dict AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '\p{{L}}+')[1:(item_id % 3 + 1)], ' ') AS name
                  FROM benchmark),
    {SENT},
    tok AS (SELECT k, {TOKENS} AS t FROM sent),
    win AS (SELECT k, p, n, array_to_string(t[p:p + n - 1], ' ') AS w
            FROM (SELECT k, t, unnest(range(1, len(t) + 1)) AS p FROM tok), (SELECT unnest([1, 2, 3]) AS n)
            WHERE p + n - 1 <= len(t)),
    hit AS (SELECT k, p, max(n) AS n, arg_max(w, n) AS w FROM win JOIN dict ON w = name WHERE length(name) >= 4 GROUP BY k, p),
    pick AS (SELECT k, list_reduce(list({{'e': p + n, 's': p, 'names': [w]}} ORDER BY p),
               lambda a, x: CASE WHEN x.s >= a.e THEN {{'e': x.e, 's': a.s, 'names': list_concat(a.names, x.names)}} ELSE a END).names AS names
             FROM hit GROUP BY k)
    SELECT doc_id, unnest(list_distinct(names)) AS company_name, s AS review_sentence FROM pick JOIN sent USING (k)"""

LEXICON = r"""words AS (
      SELECT w AS word, count(*) AS c, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic <> 1) AS b
      FROM (SELECT d.doc_id, l.toxic, unnest(regexp_extract_all(lower(d.text), '\p{L}+')) AS w FROM documents d
            LEFT JOIN (SELECT * FROM labels WHERE doc_id % 5 <> 0) l ON d.doc_id = l.doc_id) GROUP BY w),
    n AS (SELECT CAST(sum(c) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb FROM words),
    o AS (SELECT word, a + b AS seen, a + c * 0.01::DOUBLE AS ya, b + c * 0.01::DOUBLE AS yb,
                 ln(ya / (na + 0.01::DOUBLE * n - ya)) - ln(yb / (nb + 0.01::DOUBLE * n - yb)) AS d FROM words, n),
    lex AS (SELECT word, round(d, 6) AS log_odds, round(d / sqrt(1 / ya + 1 / yb), 6) AS z,
                   CASE WHEN round(d / sqrt(1 / ya + 1 / yb), 6) > 0 THEN 'NEG' ELSE 'POS' END AS sentiment
            FROM o WHERE seen >= 5 AND abs(round(d / sqrt(1 / ya + 1 / yb), 6)) >= 3)"""

SQL["learn_lexicon"] = f"WITH {LEXICON} SELECT word, log_odds, z, sentiment FROM lex"

NEGATOR_LIST = "[" + ", ".join(f"'{w}'" for w in NEGATORS) + "]"
SQL["extract_polarity"] = f"""
    WITH {LEXICON},
    {SENT},
    tok AS (SELECT k, {TOKENS} AS t FROM sent),
    plc AS (SELECT k, t[p] AS w, len(list_intersect(t[greatest(p - {SCOPE}, 1):p - 1], {NEGATOR_LIST})) > 0 AS turned
           FROM (SELECT k, t, unnest(range(1, len(t) + 1)) AS p FROM tok))
    SELECT doc_id, s AS review_sentence, w AS sentiment_word,
           CASE WHEN turned THEN CASE lex.sentiment WHEN 'POS' THEN 'NEG' ELSE 'POS' END ELSE lex.sentiment END AS sentiment,
           count(*) AS hits
    FROM plc JOIN lex ON plc.w = lex.word JOIN sent USING (k) GROUP BY k, doc_id, s, w, 4"""

SQL["agg_collect_list"] = """
    WITH n AS (SELECT user_id, coalesce(event_type, '-') AS page, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i
               FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
    SELECT user_id, CAST(i // 50 AS BIGINT) AS chunk_no, string_agg(page, '>' ORDER BY i) AS path FROM n GROUP BY user_id, i // 50"""

SQL["load_checked"] = """
    WITH n AS (SELECT l_orderkey % 50 AS k FROM lineitem),
    r AS (SELECT 'l_quantity' AS "column", 'type' AS reason, 'many' AS value FROM n WHERE k = 1
          UNION ALL SELECT unnest(['l_linestatus', 'l_shipdate']), 'missing', NULL FROM n WHERE k = 2
          UNION ALL SELECT NULL, 'surplus', 'x|y' FROM n WHERE k = 3
          UNION ALL SELECT NULL, 'loaded whole', NULL FROM n WHERE k NOT IN (1, 2, 3))
    SELECT "column", reason, value, count(*) AS lines FROM r GROUP BY ALL"""

SQL["stream_sessions"] = f"""
    WITH {_sessions_cte(3600 * 10**6)}
    SELECT u AS user_id, CAST(sn AS BIGINT) AS session_no, min(t) AS first_us, max(t) AS last_us, count(*) AS clicks
    FROM s GROUP BY u, sn"""
