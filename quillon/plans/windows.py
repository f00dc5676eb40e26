"""Window functions and frames; sorting, limits, distinct and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.windows import distinct_on, exclude_current_row, exclude_peers, groups_frame
from quillon.plans.registry import frame, sql
from quillon.session import table

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, CAST(row_number() {_W}) AS BIGINT) AS r FROM orders")
sql("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
sql("win_ntile", f"SELECT o_orderkey, CAST(ntile(3) {_W}) AS BIGINT) AS t FROM orders")
sql("win_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {_W}) AS a, lead(o_totalprice, 2) {_W}) AS b, lag(o_totalprice, 1, CAST(0 AS DOUBLE)) {_W}) AS c FROM orders")
sql("win_first_last", f"SELECT o_orderkey, first_value(o_totalprice) {_W}) AS a, last_value(o_totalprice) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM orders")
sql("win_nth_value", f"SELECT o_orderkey, nth_value(o_totalprice, 2) {_W}) AS v FROM orders")
sql("win_running", f"SELECT o_orderkey, round(sum(o_totalprice) {_W}), 2) AS s, count(*) {_W}) AS n, round(avg(o_totalprice) {_W}), 6) AS a, min(o_totalprice) {_W}) AS lo, max(o_totalprice) {_W}) AS hi FROM orders")
sql("win_null_aware", "SELECT p_partkey, count(x) OVER (PARTITION BY p_brand) AS n, CAST(sum(x) OVER (PARTITION BY p_brand) AS BIGINT) AS s, round(avg(x) OVER (PARTITION BY p_brand), 6) AS a FROM (SELECT p_partkey, p_brand, nullif(p_size, 7) AS x FROM part) t")
sql("win_default_frame_peers", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM part")
sql("win_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) {_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM part")
sql("win_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS r, round(sum(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("win_dgim_exact", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS clicks FROM events")
sql("win_distinct_count", "SELECT event_id, CAST(size(collect_set(event_type) OVER (PARTITION BY user_id)) AS BIGINT) AS kinds FROM events", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events")
sql("win_top_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 3")
sql("win_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma FROM events")
sql("win_sessionize", "SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1' DAY THEN 0 ELSE 1 END AS fresh FROM events) t")


@frame("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def win_groups_frame(spark: SparkSession, sf: str) -> DataFrame:
    return groups_frame(table(spark, sf, "part"), ["p_brand"], "p_size", -1, 1, {"n": F.count(F.lit(1))}).select("p_partkey", "n")


@frame("win_exclude_current", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM part")
def win_exclude_current(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_current_row(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], -2, 2, "p_size", "s").select("p_partkey", "s")


@frame("win_exclude_ties", "SELECT p_partkey, count(*) OVER w AS x_count, min(p_retailprice) OVER w AS x_min FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE TIES)")
def win_exclude_ties(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_peers(table(spark, sf, "part"), ["p_brand"], "p_size", "p_partkey", -3, 3, "p_retailprice", "x", True, "range").select("p_partkey", "x_count", "x_min")


@frame("win_exclude_group", "SELECT p_partkey, count(*) OVER w AS x_count, min(p_retailprice) OVER w AS x_min FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE GROUP)")
def win_exclude_group(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_peers(table(spark, sf, "part"), ["p_brand"], "p_size", "p_partkey", -3, 3, "p_retailprice", "x", False, "range").select("p_partkey", "x_count", "x_min")


# sorting and limits
sql("sort_nulls_first", "SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size, 7) AS x FROM part) t ORDER BY x ASC NULLS FIRST, p_partkey LIMIT 25")
sql("sort_nulls_last", "SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size, 7) AS x FROM part) t ORDER BY x DESC NULLS LAST, p_partkey LIMIT 25")
sql("sort_expression", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 10")
sql("sort_full", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey")
sql("limit_all", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT ALL", "SELECT r_regionkey FROM region ORDER BY r_regionkey")
sql("sort_ordinal_alias", "SELECT p_partkey AS k, p_size * 2 AS s FROM part ORDER BY 2 DESC, k LIMIT 15")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11")
sql("limit_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 5 ROWS ONLY")
sql("limit_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 10")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@frame("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_on(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@frame("reservoir_sample")
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.rand(seed=5)).limit(100)


# set operations
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 2000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"{_A} {_op} {_B}")
sql("set_order_limit", f"SELECT k FROM ({_A} UNION {_B}) t ORDER BY k DESC LIMIT 5")
sql("set_intersect_first", f"{_A} UNION {_B} INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9")
sql("set_precedence", f"({_A} EXCEPT SELECT 3 AS k) EXCEPT SELECT 4 AS k")
