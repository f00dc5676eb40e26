"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.joins import asof_join, band_join, bloom_join, intersect_keys, lateral_top_n, salted_join, spread_join
from quillon.plans.registry import frame, sql
from quillon.session import table

sql("join_inner_hash", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN customer ON c_custkey = o_custkey")


@frame("join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_nationkey < 10) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON c_nationkey = s_nationkey")
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_nationkey").alias("k"), "c_custkey")
    s = table(spark, sf, "supplier").filter("s_nationkey > 5").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return spread_join(c, s, "k", how="full").select("c_custkey", "s_suppkey")


@frame("join_null_keys", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey, nullif(p_size, 5) AS k FROM part ) a LEFT JOIN (SELECT p_partkey, nullif(p_size, 5) AS k FROM part ) b ON a.k = b.k AND a.p_partkey < b.p_partkey")
def join_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda c: table(spark, sf, "part").select(F.expr("nullif(p_size, 5)").alias("k"), F.col("p_partkey").alias(c))
    return spread_join(side("a"), side("b"), "k", F.col("a") < F.col("b")).select("a", "b")


sql("join_merge_hint", "SELECT /*+ MERGE(o) */ c_custkey, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_custkey")
sql("join_broadcast_hint", "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer JOIN nation n ON c_nationkey = n_nationkey")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey + b.n_regionkey < b.n_nationkey")
sql("join_outer_apply", "SELECT n_nationkey, x.c_custkey, x.c_acctbal FROM nation LEFT JOIN LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500 ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x ON true")
sql("join_cross", "SELECT r_name, s_suppkey FROM region CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 4) s")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y")
sql("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x LEFT JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)")
sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql("join_lateral", "SELECT n_nationkey, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x")
sql("join_left_lateral", "SELECT n_nationkey, x.s_suppkey FROM nation LEFT JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1) x ON true")
sql("join_cross_apply", "SELECT n_nationkey, x.total FROM nation, LATERAL (SELECT round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey = n_nationkey) x")
sql("join_view_cte", "WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT c_name, m FROM customer JOIN big ON c_custkey = o_custkey WHERE m > 300000")
sql("join_multiway", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")


@frame("join_bloom_shape", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 15 GROUP BY l_returnflag")
def join_bloom_shape(spark: SparkSession, sf: str) -> DataFrame:
    few = table(spark, sf, "part").filter("p_size = 15").select(F.col("p_partkey").alias("l_partkey"))
    return bloom_join(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag"), few, "l_partkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


sql("join_grace_hash", "SELECT /*+ SHUFFLE_HASH(orders) */ count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")


@frame("join_band", "SELECT p_partkey, lo, hi FROM part JOIN (SELECT range * 10 AS lo, range * 10 + 4 AS hi FROM range(6)) b ON p_size BETWEEN lo AND hi")
def join_band(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(6).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi"))
    return band_join(table(spark, sf, "part").select("p_partkey", "p_size"), bands, "p_size", "lo", "hi", 10).select("p_partkey", "lo", "hi")


@frame(
    "join_asof",
    "SELECT e.event_id, (SELECT max(value) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = "
    "(SELECT max(ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS last_purchase FROM events e WHERE e.event_type = 'view'",
)
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return asof_join(views, bought, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@frame("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def join_salted(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linenumber")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return salted_join(lines, orders, "k").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@frame("join_leapfrog", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def join_leapfrog(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda t, c: table(spark, sf, t).select(F.col(c).alias("k"))
    return intersect_keys(key("nation", "n_nationkey"), key("customer", "c_nationkey"), key("supplier", "s_nationkey"))


@frame("join_lateral_top_n", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey) WHERE r <= 3")
def join_lateral_top_n(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return lateral_top_n(c, o, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("c_custkey", "o_orderkey")
