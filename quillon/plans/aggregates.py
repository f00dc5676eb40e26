"""Grouping and aggregate functions, pivots."""

from __future__ import annotations

from quillon.plans.registry import sql

sql("agg_group_by", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
sql("agg_group_by_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
sql("agg_group_by_ordinal", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2")
sql("agg_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c, round(avg(o_totalprice), 4) AS a FROM orders")
sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m, coalesce(sum(o_totalprice), CAST(0 AS DOUBLE)) AS total FROM orders WHERE o_orderkey < 0")
sql("agg_having", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
sql("agg_having_global", "SELECT count(*) AS n FROM orders HAVING count(*) > 5")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
sql("agg_total", "SELECT p_brand, coalesce(sum(nullif(p_retailprice, p_retailprice)), CAST(0 AS DOUBLE)) AS total FROM part GROUP BY p_brand")
sql("agg_nulls", "SELECT count(x) AS n, CAST(sum(x) AS BIGINT) AS s, round(avg(x), 6) AS a FROM (SELECT nullif(p_size, 7) AS x FROM part) t")
sql("agg_median", "SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
sql("agg_percentile_cont", "SELECT o_orderstatus, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p FROM orders GROUP BY o_orderstatus")
sql("agg_percentile_disc", "SELECT o_orderstatus, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS p FROM orders GROUP BY o_orderstatus")
sql("agg_mode_ties", "SELECT o_custkey, mode(o_orderstatus, true) AS m FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_orderstatus AS m FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY o_custkey, o_orderstatus) t WHERE r = 1")
sql("agg_mode", "SELECT mode() WITHIN GROUP (ORDER BY x) AS m FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE CAST(p_partkey AS INT) END AS x FROM part) t", "SELECT mode(x) AS m FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE CAST(p_partkey AS INT) END AS x FROM part) t")
sql("agg_stddev", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(stddev_pop(l_quantity), 6) AS b, round(variance(l_quantity), 5) AS c, round(var_pop(l_quantity), 5) AS d FROM lineitem GROUP BY l_returnflag")
sql("agg_stddev_single", "SELECT r_regionkey, stddev_samp(r_regionkey) AS s FROM region GROUP BY r_regionkey")
sql("agg_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS a, round(covar_pop(l_quantity, l_extendedprice), 3) AS b, round(covar_samp(l_quantity, l_extendedprice), 3) AS c FROM lineitem")
sql("agg_regr", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 3) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS c, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS d FROM lineitem")
sql("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_string_agg_distinct", "SELECT listagg(DISTINCT c_mktsegment, '|') WITHIN GROUP (ORDER BY c_mktsegment) AS s FROM customer", "SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS s FROM customer")
sql("agg_array_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey")
sql("agg_json_agg", "SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_name))) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
sql("agg_json_object", "SELECT to_json(map_from_entries(array_sort(collect_list(struct(r_name, r_regionkey))))) AS j FROM region", "SELECT '{' || string_agg('\"' || r_name || '\":' || r_regionkey, ',' ORDER BY r_name) || '}' AS j FROM region")
sql("agg_bool", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS b, every(o_totalprice > 0) AS c FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS b, bool_and(o_totalprice > 0) AS c FROM orders GROUP BY o_orderstatus")
sql("agg_any_value", "SELECT n_regionkey, any_value(n_regionkey) AS v, max_by(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey")
sql(
    "agg_pivot",
    "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (round(sum(l_quantity), 2) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
    "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY l_returnflag",
)
sql(
    "agg_unpivot",
    "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, nullif(p_retailprice, 901) AS price FROM part) UNPIVOT (v FOR what IN (size, price))",
)
sql("agg_sort_group", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
sql("agg_partial_final", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_suppkey")
sql("agg_nested_window", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
