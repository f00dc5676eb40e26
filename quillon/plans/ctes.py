"""Common table expressions, recursion, graphs and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.dml import with_sequence
from quillon.operators.recursion import bfs_levels, depth_first, has_cycle, min_label_components, recursive_union, shortest_paths, shortest_routes, topological_levels
from quillon.plans.registry import frame, sql
from quillon.session import table

sql("cte_chained", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 1500000) SELECT c_name FROM customer JOIN b ON c_custkey = o_custkey")
sql("cte_column_list", "WITH t(k, n) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT k, n FROM t WHERE k < 3")
sql("cte_union_body", "WITH t AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) SELECT count(*) AS n FROM t")
sql("cte_recursive_counter", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
sql("cte_recursive_fibonacci", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")
sql(
    "cte_recursive_cycle",
    "WITH RECURSIVE t(node, path, cyc) AS (SELECT CAST(1 AS BIGINT), array(CAST(1 AS BIGINT)), false UNION ALL SELECT e.dst, array_append(t.path, e.dst), array_contains(t.path, e.dst) "
    "FROM t JOIN (SELECT n_nationkey AS src, CAST((n_nationkey * 2) % 7 AS BIGINT) AS dst FROM nation WHERE n_nationkey < 7) e ON e.src = t.node WHERE NOT t.cyc) SELECT node, CAST(size(path) AS BIGINT) AS depth, cyc FROM t",
    "WITH RECURSIVE t(node, path, cyc) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], false UNION ALL SELECT e.dst, list_append(t.path, e.dst), list_contains(t.path, e.dst) "
    "FROM t JOIN (SELECT n_nationkey AS src, CAST((n_nationkey * 2) % 7 AS BIGINT) AS dst FROM nation WHERE n_nationkey < 7) e ON e.src = t.node WHERE NOT t.cyc) SELECT node, CAST(len(path) AS BIGINT) AS depth, cyc FROM t",
)
sql("cte_search_breadth", "WITH RECURSIVE t(n, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT n * 2, level + 1 FROM t WHERE n < 100) SELECT n, level FROM t ORDER BY level, n")
sql("subquery_scalar_hoisted", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("subquery_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer WHERE c_acctbal > 5000")
sql("subquery_correlated_in", "SELECT o_orderkey FROM orders o WHERE o.o_orderkey IN (SELECT l.l_orderkey FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
sql("subquery_limit_inside", "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k")
sql("subquery_nested", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE '%A'))")
sql("subquery_from_agg", "SELECT max(n) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t")

#: Edges between nations, and between orders' customers and later ones; no table holds a graph.
_EDGES = "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst, CAST(1 + n_nationkey % 4 AS DOUBLE) AS weight FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 5) % 25 AS BIGINT), CAST(2 + n_nationkey % 3 AS DOUBLE) FROM nation WHERE n_nationkey % 2 = 0"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.sql(_EDGES)


@frame("cte_recursive_union", f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def cte_recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return recursive_union(spark.range(1, 2).toDF("node"), lambda new: new.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))


@frame("graph_bfs", f"WITH RECURSIVE e AS ({_EDGES}), r(node, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node WHERE level < 25) SELECT node, min(level) AS level FROM r GROUP BY node")
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return bfs_levels(edges(spark, sf), spark.range(1, 2))


@frame("graph_dijkstra", f"WITH RECURSIVE e AS ({_EDGES}), r(node, cost, hops) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT e.dst, cost + weight, hops + 1 FROM r JOIN e ON e.src = r.node WHERE hops < 25) SELECT node, min(cost) AS cost FROM r GROUP BY node")
def graph_dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    return shortest_paths(edges(spark, sf), spark.range(1, 2))


@frame("graph_topological", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey * 2 + 1 AS BIGINT) AS dst FROM nation WHERE n_nationkey < 12), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def graph_topological(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").filter("n_nationkey < 12")
    return topological_levels(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") * 2 + 1).cast("long").alias("dst")))


@frame("graph_components", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 6) % 24 AS BIGINT) AS dst FROM nation), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, seen) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return min_label_components(n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 6) % 24).cast("long").alias("dst")))


_ROUND = "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS BIGINT) AS dst FROM nation WHERE n_nationkey < {}"
_HAS = "WITH RECURSIVE e AS ({0}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT {1} AS n, count(*) > 0 AS has_cycle FROM r WHERE a = b"


@frame("graph_cycle_check", f"{_HAS.format(_ROUND.format(15), 15)} UNION ALL SELECT * FROM ({_HAS.format(_ROUND.format(4), 4)})")
def graph_cycle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of five nodes, and a chain that has none."""
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.createDataFrame([(n, has_cycle(spark.sql(_ROUND.format(n)))) for n in (15, 4)], "n int, has_cycle boolean")


@frame("graph_shortest_path", f"WITH RECURSIVE e AS ({_EDGES}), r(node, cost, path) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), [CAST(1 AS BIGINT)] UNION ALL SELECT e.dst, cost + weight, list_append(path, e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT list_contains(path, e.dst)), w AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, len(path), path) AS k FROM r) SELECT node, cost, array_to_string(path, '>') AS path FROM w WHERE k = 1")
def graph_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return shortest_routes(edges(spark, sf), spark.range(1, 2)).select("node", "cost", F.array_join("path", ">").alias("path"))


_TREE = "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey * 2 + k AS BIGINT) AS dst FROM nation, (VALUES (1), (2)) v(k) WHERE n_nationkey < 9"


@frame("graph_dfs", f"WITH RECURSIVE e AS ({_TREE}), r(node, path) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT list_contains(path, e.dst)) SELECT node, row_number() OVER (ORDER BY path) AS visit FROM r")
def graph_dfs(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    paths = depth_first(spark.sql(_TREE), spark.range(1))
    return with_sequence(paths.withColumn("key", F.transform("path", lambda x: x)), ["key"], "visit").select("node", "visit")


sql(
    "cte_search_depth",
    "WITH RECURSIVE t(n, path) AS (SELECT CAST(1 AS BIGINT), array(CAST(1 AS BIGINT)) UNION ALL SELECT c.k + t.n * 2, array_append(t.path, c.k + t.n * 2) FROM t JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT CAST(1 AS BIGINT)) c ON true WHERE t.n < 16) SELECT n, array_join(path, '.') AS path FROM t ORDER BY t.path",
    "WITH RECURSIVE t(n, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT c.k + t.n * 2, list_append(t.path, c.k + t.n * 2) FROM t JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT CAST(1 AS BIGINT)) c ON true WHERE t.n < 16) SELECT n, array_to_string(path, '.') AS path FROM t ORDER BY t.path",
)
