"""Analytic queries in the manner of a known benchmark, fitted to the columns that the tables have."""

from __future__ import annotations

from quillon.plans.registry import sql

_REV = "l_extendedprice * (1 - l_discount)"
sql("h_q3_shipping_priority", f"SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
sql("h_q4_order_priority", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority")
sql("h_q5_local_supplier", f"SELECT n_name, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN (SELECT min(r_name) FROM region) GROUP BY n_name")
sql("h_q6_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
sql("h_q7_volume", f"SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum({_REV}), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_nationkey IN (1, 2, 3) AND b.n_nationkey IN (1, 2, 3) GROUP BY a.n_name, b.n_name, year(l_shipdate)")
sql("h_q8_market_share", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(CASE WHEN n.n_nationkey = 3 THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS share FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation n ON s_nationkey = n.n_nationkey WHERE p_size < 20 GROUP BY year(o_orderdate)")
sql("h_q10_returned", f"SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("h_q12_priority_counts", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN CAST(1 AS BIGINT) ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN CAST(0 AS BIGINT) ELSE 1 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS high, count(*) FILTER (WHERE NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus")
sql("h_q13_distribution", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey) t GROUP BY c_count")
sql("h_q14_promo", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'")
sql("h_q15_top_supplier", f"WITH r AS (SELECT l_suppkey, round(sum({_REV}), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-04-01 00:00:00' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)")
sql("h_q17_small_quantity", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' AND l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
sql("h_q18_large_volume", "SELECT c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY c_custkey, o_orderkey, o_totalprice")
sql("h_q19_discounted", f"SELECT round(sum({_REV}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21) OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30)")
sql("h_q21_waiting", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name")
sql("h_q22_idle_customers", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) GROUP BY c_mktsegment")
sql("r_monthly_sales", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY date_trunc('month', o_orderdate)")
sql("r_growth", "SELECT y, s, round(s / lag(s) OVER (ORDER BY y), 6) AS growth FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY year(o_orderdate)) t")
sql("r_error_rate", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, round(avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END), 6) AS rate FROM events GROUP BY CAST(ts AS DATE)")
