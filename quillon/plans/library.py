"""Time series, vectors, text, documents, sketches, changes, user functions, files and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillon.operators import analytics as A
from quillon.operators import dml as D
from quillon.operators.catalog import RowPolicies, Sequence, Tables, dump, pg_stat_user_tables, pg_tables, restore
from quillon.operators.cursors import limited
from quillon.operators.procedures import Routines
from quillon.operators.recursion import written
from quillon.operators.scans import shared_dir
from quillon.plans.registry import frame, sql
from quillon.session import register, table
from quillon.sources.text_files import copy_from, copy_to
from quillon.streaming import jobs

# time series
_BUCKET = "CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600"


@frame("ts_downsample", f"SELECT event_type, {_BUCKET} AS bucket, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type, {_BUCKET}")
def ts_downsample(spark: SparkSession, sf: str) -> DataFrame:
    d = A.downsample(table(spark, sf, "events"), "event_type", "ts", "value", 3600)
    return d.withColumn("avg", F.round("avg", 6)).withColumn("sum", F.round("sum", 4))


sql("ts_tumbling_window", "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS start, event_type, n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 day') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2)", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")


@frame("ts_range_query", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00' AND event_type = 'click'")
def ts_range_query(spark: SparkSession, sf: str) -> DataFrame:
    return A.range_query(table(spark, sf, "events"), "ts", "2024-01-02 00:00:00", "2024-01-04 00:00:00", event_type="click").select("event_id", "value")


@frame("ts_latest", "SELECT event_type, arg_max(value, {'t': ts, 'i': event_id}) AS latest, max(ts) AS at FROM events GROUP BY event_type")
def ts_latest(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest(table(spark, sf, "events"), "event_type", "ts", "value", "event_id")


sql("ts_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7' DAY")
sql("ts_metrics", "SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")


@frame("ts_gap_fill", "WITH b AS (SELECT event_type, CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS bucket, max(value) AS v FROM events GROUP BY 1, 2), e AS (SELECT event_type, min(bucket) AS a, max(bucket) AS z FROM b GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(a, z, 600)) AS bucket FROM e) SELECT g.event_type, g.bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.bucket) AS v FROM g LEFT JOIN b USING (event_type, bucket)")
def ts_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    b = e.groupBy("event_type", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 600).alias("bucket")).agg(F.max("value").alias("v"))
    return A.gap_fill(b, "event_type", "bucket", 600, "v")


# vectors
def _query(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]]


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_V = "CAST({} AS DOUBLE[])"


@frame("vec_knn_cosine", f"SELECT vec_id, round(list_cosine_similarity({_V.format('embedding')}, {_V.format(_Q)}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity({_V.format('embedding')}, {_V.format(_Q)}) DESC, vec_id LIMIT 10")
def vec_knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest(table(spark, sf, "embeddings"), _query(spark, sf), 10)


@frame("vec_knn_euclidean", f"SELECT vec_id, round(list_distance({_V.format('embedding')}, {_V.format(_Q)}), 6) AS score FROM embeddings ORDER BY list_distance({_V.format('embedding')}, {_V.format(_Q)}), vec_id LIMIT 10")
def vec_knn_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest(table(spark, sf, "embeddings"), _query(spark, sf), 10, "euclidean")


@frame("vec_knn_filtered", f"SELECT vec_id, round(list_inner_product({_V.format('embedding')}, {_V.format(_Q)}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY list_inner_product({_V.format('embedding')}, {_V.format(_Q)}) DESC, vec_id LIMIT 5")
def vec_knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest(table(spark, sf, "embeddings"), _query(spark, sf), 5, "dot", F.col("label") == 1)


@frame("matrix_multiply", "WITH m AS (SELECT p_size % 7 AS i, p_partkey % 5 AS j, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY 1, 2) SELECT a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2")
def matrix_multiply(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").groupBy((F.col("p_size") % 7).alias("i"), (F.col("p_partkey") % 5).alias("j")).agg(F.sum("p_size").alias("v"))
    return A.matrix_multiply(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy((F.col("p_size") % 7).alias("i"), (F.col("p_partkey") % 5).alias("j")).agg(F.sum("p_size").alias("v"))


@frame("matrix_transpose", "SELECT p_partkey % 5 AS i, p_size % 7 AS j, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY 1, 2")
def matrix_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return A.matrix_transpose(_matrix(spark, sf))


@frame("matrix_transpose_trace", "SELECT CAST(sum(v) AS BIGINT) AS trace FROM (SELECT p_size % 7 AS i, p_partkey % 5 AS j, p_size AS v FROM part) m WHERE i = j")
def matrix_transpose_trace(spark: SparkSession, sf: str) -> DataFrame:
    return A.matrix_trace(A.matrix_transpose(_matrix(spark, sf)))


@frame("spatial_box", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1200")
def spatial_box(spark: SparkSession, sf: str) -> DataFrame:
    return A.box_search(table(spark, sf, "part"), "p_size", "p_retailprice", (10, 950, 20, 1200)).select("p_partkey")


@frame("spatial_nearest", "SELECT p_partkey, round((p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000), 4) AS d2 FROM part ORDER BY (p_size - 25) * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000), p_partkey LIMIT 8")
def spatial_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return A.nearest_points(table(spark, sf, "part"), "p_size", "p_retailprice", (25, 1000), 8, "p_partkey").select("p_partkey", F.round("d2", 4).alias("d2"))


@frame("interval_merge", "WITH t AS (SELECT l_suppkey AS k, CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS a FROM lineitem), w AS (SELECT k, a, a + 3 AS b, max(a + 3) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t), g AS (SELECT k, a, b, sum(CASE WHEN a <= m THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM w) SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, i")
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), d.alias("a"), (d + 3).alias("b"))
    return A.merge_intervals(t, "k", "a", "b")


_DAY = "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)"


@frame("interval_stabbing", f"SELECT p_partkey, o_orderkey FROM part JOIN (SELECT o_orderkey, {_DAY} AS a FROM orders WHERE o_orderstatus = 'F') o ON p_partkey * 7 BETWEEN a AND a + 3")
def interval_stabbing(spark: SparkSession, sf: str) -> DataFrame:
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    intervals = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", d.alias("a"), (d + 3).alias("b"))
    return A.stabbed(table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("p")), intervals, "p", "a", "b", 4).select("p_partkey", "o_orderkey")

# text
_STOP = ", ".join(f"'{w}'" for w in A.STOP_WORDS)
_POST = f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})) AS ts FROM documents), p AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS doc_len, unnest(ts) AS term FROM w) GROUP BY 1, 2, 3)"


@frame("text_postings", f"{_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term HAVING count(*) > 5")
def text_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = A.postings(table(spark, sf, "documents"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter("df > 5")


_SCORE = "SELECT p.doc_id, round(sum(tf / doc_len * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) d ON p.term = d.term, (SELECT count(*) AS n FROM documents) x WHERE p.term IN ('license', 'mit') GROUP BY p.doc_id"


@frame("text_tf_idf", f"{_POST} {_SCORE}")
def text_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    return A.tf_idf_search(table(spark, sf, "documents"), ["license", "mit"])


@frame("text_and_search", f"{_POST} {_SCORE} HAVING count(*) = 2")
def text_and_search(spark: SparkSession, sf: str) -> DataFrame:
    return A.tf_idf_search(table(spark, sf, "documents"), ["license", "mit"], "and")


@frame("text_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])mit[^a-z0-9]+license([^a-z0-9]|$)')")
def text_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return A.phrase_search(table(spark, sf, "documents"), ["mit", "license"])


# sketches: estimates are held against exact values, so the rows say whether they are near
@frame("sketch_hll", "SELECT count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem")
def sketch_hll(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    by = e.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", F.lit(14)).alias("s"))
    n = F.hll_sketch_estimate(F.hll_union_agg("s"))
    exact = e.agg(F.count_distinct("l_partkey").alias("x"))
    return by.agg(n.alias("n")).crossJoin(exact).select(F.col("x").alias("exact"), (F.abs(F.col("n") - F.col("x")) <= 0.05 * F.col("x")).alias("near"))


@frame("sketch_approx_distinct", "SELECT count(DISTINCT o_custkey) AS exact, true AS near FROM orders")
def sketch_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and estimated counts are two aggregations: in one, every distinct key would have a sketch of its own."""
    o = table(spark, sf, "orders")
    estimate = o.agg(F.approx_count_distinct("o_custkey", 0.02).alias("n"))
    exact = o.agg(F.count_distinct("o_custkey").alias("x"))
    return estimate.crossJoin(exact).select(F.col("x").alias("exact"), (F.abs(F.col("n") - F.col("x")) <= 0.1 * F.col("x")).alias("near"))


@frame("sketch_quantile", "SELECT round(quantile_cont(o_totalprice, 0.9), 4) AS exact, true AS near FROM orders")
def sketch_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.round(F.percentile("o_totalprice", 0.9), 4).alias("exact"), (F.abs(F.percentile_approx("o_totalprice", 0.9, 10000) / F.percentile("o_totalprice", 0.9) - 1) < 0.01).alias("near"))


@frame("sketch_count_min", "SELECT event_type AS value, count(*) AS estimate FROM events GROUP BY event_type")
def sketch_count_min(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return A.count_min_estimate(A.count_min(e, "event_type"), e, "event_type")


@frame("sketch_bloom", "SELECT count(DISTINCT o_custkey) AS members, true AS all_found, true AS few_others FROM orders")
def sketch_bloom(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders, in two merged filters; of as many keys that were never seen, few are taken for members."""
    o = written(table(spark, sf, "orders").select("o_custkey").distinct())
    n = o.count()
    half = lambda k: A.bloom_filter(o.filter(F.col("o_custkey") % 2 == k), "o_custkey", n)
    b = written(A.bloom_merge(half(0), half(1)))
    found = A.might_contain(o, "o_custkey", b).agg(F.count(F.lit(1)).alias("hit"))
    others = A.might_contain(o.select((-F.col("o_custkey") - 1).alias("k")), "k", b).agg(F.count(F.lit(1)).alias("wrong"))
    return found.crossJoin(others).select(F.lit(n).cast("long").alias("members"), (F.col("hit") == n).alias("all_found"), (F.col("wrong") <= 0.03 * n + 3).alias("few_others"))


@frame("sketch_quantile_merge", "SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS exact, true AS near FROM orders")
def sketch_quantile_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A sketch for each status, merged; Spark keeps KLL sketches as binary values."""
    o = table(spark, sf, "orders")
    o.groupBy("o_orderstatus").agg(F.expr("kll_sketch_agg_double(o_totalprice)").alias("s")).createOrReplaceTempView("quillon_sketches")
    merged = spark.sql("SELECT kll_sketch_get_quantile_double(reduce(array_agg(s), CAST(NULL AS BINARY), (a, x) -> CASE WHEN a IS NULL THEN x ELSE kll_sketch_merge_double(a, x) END), 0.5D) AS q FROM quillon_sketches")
    exact = o.agg(F.percentile("o_totalprice", 0.5).alias("x"))
    return merged.crossJoin(exact).select(F.round("x", 4).alias("exact"), (F.abs(F.col("q") / F.col("x") - 1) < 0.05).alias("near"))


@frame("sketch_equi_height", "SELECT count(*) AS exact, true AS near, true AS level FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000")
def sketch_equi_height(spark: SparkSession, sf: str) -> DataFrame:
    """A range's count, whether the histogram's estimate is near, and whether its buckets are about equally high."""
    o = table(spark, sf, "orders")
    h = written(A.equi_height_histogram(o, "o_totalprice", 20))
    exact = o.filter("o_totalprice BETWEEN 50000 AND 150000").agg(F.count(F.lit(1)).alias("exact"))
    level = h.agg((F.max("n") < 1.2 * F.min("n") + 2).alias("level"))
    return A.range_estimate(h, 50000, 150000).crossJoin(exact).crossJoin(level).select("exact", (F.abs(F.col("estimate") - F.col("exact")) < 0.05 * F.col("exact") + 2).alias("near"), "level")


sql("sketch_heavy_hitters", "SELECT item, CAST(count AS BIGINT) AS n FROM (SELECT inline(approx_top_k(event_type, 5)) FROM events)", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 5")


@frame("sketch_minhash", "SELECT true AS near, count(DISTINCT list_sort(list_distinct(string_split(text, ' ')))) AS sets FROM documents")
def sketch_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is signed; equal sets of words once, since their signatures are equal too."""
    w = table(spark, sf, "documents").select(F.array_sort(F.array_distinct(F.split("text", " "))).alias("w")).filter("w IS NOT NULL").distinct()
    path = shared_dir(spark)
    w.select(F.monotonically_increasing_id().alias("id"), "w", A.minhash(F.col("w")).alias("s")).write.parquet(path)
    signed = spark.read.parquet(path)
    near = A.minhash_pairs(signed).agg((F.avg(F.abs(F.col("estimate") - F.col("exact"))) < 0.1).alias("near"))
    return near.crossJoin(signed.agg(F.count(F.lit(1)).alias("sets")))


@frame("sketch_histogram", "SELECT CAST(least(greatest(floor(p_size / 10.0) + 1, 0), 6) AS BIGINT) AS bucket, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1")
def sketch_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.equi_width_histogram(table(spark, sf, "part"), "p_size", 0.0, 50.0, 5)




@frame("sketch_cardinality_multi", "SELECT count(DISTINCT (l_partkey, l_linenumber)) AS exact, true AS near FROM lineitem")
def sketch_cardinality_multi(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.concat_ws("\x1f", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    t = table(spark, sf, "lineitem")
    estimate = t.agg(F.hll_sketch_estimate(F.hll_sketch_agg(pair, F.lit(14))).alias("n"))
    exact = t.agg(F.count_distinct("l_partkey", "l_linenumber").alias("x"))
    return estimate.crossJoin(exact).select(F.col("x").alias("exact"), (F.abs(F.col("n") - F.col("x")) <= 0.05 * F.col("x")).alias("near"))


# documents
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@frame("doc_find", f"SELECT event_id FROM events WHERE {_K} > 50 AND {_K} <= 60")
def doc_find(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_find(table(spark, sf, "events"), "props", {"k": {"$gt": 50, "$lte": 60, "$exists": True}}).select("event_id")


@frame("doc_aggregate", f"SELECT json_extract_string(props, '$.k') AS _id, count(*) AS n, sum({_K}) AS s FROM events WHERE {_K} >= 90 GROUP BY 1 ORDER BY n DESC, _id LIMIT 5")
def doc_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_aggregate(table(spark, sf, "events"), "props", [{"$match": {"k": {"$gte": 90}}}, {"$group": {"_id": "$k", "n": {"$count": {}}, "s": {"$sum": "$k"}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 5}])


# changes
def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")


def _changed(s: DataFrame) -> DataFrame:
    return s.filter("s_suppkey > 50").select((F.col("s_suppkey") + 20).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))


_OLD, _NEW = "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "SELECT s_suppkey + 20 AS s_suppkey, 'new ' || s_name AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey > 50"


@frame("dml_insert_select", f"{_OLD} UNION ALL SELECT c_custkey + 100000, c_name, c_acctbal FROM customer WHERE c_custkey < 10")
def dml_insert_select(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey < 10")
    return _supplier(spark, sf).union(c.select(F.col("c_custkey") + 100000, "c_name", "c_acctbal"))


@frame("dml_upsert_nothing", f"{_OLD} UNION ALL SELECT * FROM ({_NEW}) n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def dml_upsert_nothing(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.upsert(s, _changed(s), "s_suppkey")


@frame("dml_upsert_update", f"SELECT o.s_suppkey, o.s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (s_suppkey) UNION ALL SELECT * FROM ({_NEW}) n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def dml_upsert_update(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.upsert(s, _changed(s), "s_suppkey", {"s_acctbal": F.col("excluded.s_acctbal")})


@frame("dml_merge", f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, CASE WHEN o.s_suppkey IS NULL THEN n.s_acctbal ELSE o.s_acctbal END AS s_acctbal FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.s_suppkey = n.s_suppkey")
def dml_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.merge(s, _changed(s), "s_suppkey", {"s_name": F.col("s.s_name")})


@frame("dml_update_from", f"SELECT o.s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, o.s_acctbal FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (s_suppkey)")
def dml_update_from(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.update_from(s, _changed(s), "s_suppkey", {"s_name": F.col("s.s_name")}, "s_name")


@frame("dml_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark: SparkSession, sf: str) -> DataFrame:
    return D.update_where(_supplier(spark, sf).drop("s_name"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)[0]


@frame("dml_update_returning", "SELECT s_suppkey, s_name, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_acctbal > 5000")
def dml_update_returning(spark: SparkSession, sf: str) -> DataFrame:
    return D.update_where(_supplier(spark, sf), {"s_acctbal": F.col("s_acctbal") * 2}, F.col("s_acctbal") > 5000)[1]


@frame("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 100000, false)")
def dml_delete(spark: SparkSession, sf: str) -> DataFrame:
    return D.delete_where(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") < 100000)[0].select("o_orderkey")


@frame("dml_delete_returning", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000")
def dml_delete_returning(spark: SparkSession, sf: str) -> DataFrame:
    return D.delete_where(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") < 100000)[1]


@frame("dml_insert_values", f"{_OLD} UNION ALL VALUES (9001, 'first', 0.5), (9002, 'unnamed', 7.0), (9003, NULL, NULL)")
def dml_insert_values(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    rows = [{"s_suppkey": 9001, "s_name": "first", "s_acctbal": 0.5}, {"s_suppkey": 9002, "s_acctbal": 7.0}, {"s_suppkey": 9003, "s_name": None, "s_acctbal": None}]
    return s.unionByName(D.insert_values(s, rows, {"s_name": F.lit("unnamed")}))


@frame("dml_insert_returning", "SELECT * FROM (VALUES (CAST(9001 AS BIGINT), 'unnamed', CAST(0 AS DOUBLE))) t(s_suppkey, s_name, s_acctbal)")
def dml_insert_returning(spark: SparkSession, sf: str) -> DataFrame:
    return D.insert_values(_supplier(spark, sf), [{"s_suppkey": 9001}], {"s_name": F.lit("unnamed"), "s_acctbal": F.lit(0.0)})


_ODD = "SELECT nullif(s_suppkey, {0}) AS k, s_suppkey AS id, s_acctbal AS v FROM supplier"
_TWICE = "SELECT k, id + 500 AS id, v + 1 AS v FROM (" + _ODD.format(3) + ") a UNION ALL SELECT k, id + 900, v + 2 FROM (" + _ODD.format(3) + ") a WHERE id % 2 = 0 UNION ALL SELECT k + 100000, id + 700, v FROM (" + _ODD.format(3) + ") a WHERE id < 4"
_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM ({_TWICE}) x) y WHERE r = 1 OR k IS NULL)"


def _odd(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A target and a source with null keys and several rows of a key."""
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(_ODD.format(2)), spark.sql(_TWICE)


@frame("dml_merge_odd_keys", f"SELECT t.k, t.id, CASE WHEN s.id IS NOT NULL THEN s.v ELSE t.v END AS v FROM ({_ODD.format(2)}) t LEFT JOIN {_FIRST} s ON t.k = s.k UNION ALL SELECT k, id, v FROM {_FIRST} s WHERE NOT EXISTS (SELECT 1 FROM ({_ODD.format(2)}) t WHERE t.k = s.k)")
def dml_merge_odd_keys(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _odd(spark, sf)
    return D.merge(target, source, "k", {"v": F.col("s.v")}, order=["id"])


@frame("dml_upsert_odd_keys", f"SELECT t.k, t.id, CASE WHEN s.id IS NOT NULL THEN s.v ELSE t.v END AS v FROM ({_ODD.format(2)}) t LEFT JOIN {_FIRST} s ON t.k = s.k UNION ALL SELECT k, id, v FROM {_FIRST} s WHERE NOT EXISTS (SELECT 1 FROM ({_ODD.format(2)}) t WHERE t.k = s.k)")
def dml_upsert_odd_keys(spark: SparkSession, sf: str) -> DataFrame:
    target, source = _odd(spark, sf)
    return D.upsert(target, source, "k", {"v": F.col("excluded.v")}, order=["id"])


@frame("dml_delete_using", f"{_OLD} WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_NEW}) n)")
def dml_delete_using(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.delete_using(s, _changed(s), "s_suppkey")


@frame("dml_replace", f"SELECT * FROM ({_OLD}) o WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_NEW}) n) UNION ALL {_NEW}")
def dml_replace(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return D.delete_using(s, _changed(s), "s_suppkey").unionByName(_changed(s))


@frame("ddl_generated_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def ddl_generated_column(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    made = D.GeneratedColumns({"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)})
    return made.stored(rows).select("l_orderkey", "l_linenumber", "net")


@frame("ddl_ctas", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def ddl_ctas(spark: SparkSession, sf: str) -> DataFrame:
    return D.MaterializedView(lambda: table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))).read()


@frame("ddl_matview_refresh", "SELECT count(*) AS n FROM orders")
def ddl_matview_refresh(spark: SparkSession, sf: str) -> DataFrame:
    source = [table(spark, sf, "orders").limit(0)]
    view = D.MaterializedView(lambda: source[0].agg(F.count(F.lit(1)).alias("n")))
    view.read()
    source[0] = table(spark, sf, "orders")
    view.notify()
    return view.read()


@frame("ddl_sequence", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) * 2 + 98 AS n FROM orders")
def ddl_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_sequence(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "n", 100, 2).select("o_orderkey", "n")


@frame("constraint_check", "SELECT c_custkey, 'balance' AS rule FROM customer WHERE NOT (c_acctbal > 0) UNION ALL SELECT c_custkey, 'nation' FROM customer WHERE NOT (c_nationkey < 20)")
def constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    return D.violations(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 20}, "c_custkey")


@frame("constraint_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def constraint_unique(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_keys(table(spark, sf, "orders"), "o_custkey")


@frame("constraint_foreign_key", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 100)")
def constraint_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    return D.orphans(table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_custkey > 100"), "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("n"))


@frame("cdc_snapshot_diff", f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'insert' WHEN n.s_suppkey IS NULL THEN 'delete' ELSE 'update' END AS op FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.s_suppkey = n.s_suppkey")
def cdc_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    return A.snapshot_diff(s, _changed(s), "s_suppkey")


@frame("merge_sorted_dedup", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def merge_sorted_dedup(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.union(b).dropDuplicates().orderBy("k")


@frame("security_row_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7")
def security_row_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = RowPolicies()
    p.add("customer", "agent", F.col("c_nationkey") == 7)
    p.add("customer", "auditor", F.lit(True))
    return p.read("customer", table(spark, sf, "customer"), "agent").select("c_custkey", "c_acctbal")


# files
@frame("copy_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    copy_to(table(spark, sf, "nation"), path)
    return copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@frame("copy_text_nulls", "SELECT p_partkey, nullif(p_size, 7) AS x FROM part")
def copy_text_nulls(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    copy_to(table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("x")), path, "text", False)
    return copy_from(spark, path, "p_partkey bigint, x int", "text", False)


# user functions
@frame("udf_sql_scalar", "SELECT p_partkey, p_retailprice * 1.19 AS gross FROM part")
def udf_sql_scalar(spark: SparkSession, sf: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.19D")
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, quillon_gross(p_retailprice) AS gross FROM part")


@frame("udf_sql_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def udf_sql_table(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_nations(r INT) RETURNS TABLE (n_nationkey INT, n_name STRING) RETURN SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r")
    return spark.sql("SELECT * FROM quillon_nations(2)")


@frame("udf_pandas", "SELECT c_custkey, round(c_acctbal * 2 + 1, 4) AS v FROM customer")
def udf_pandas(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf(DoubleType())
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return table(spark, sf, "customer").select("c_custkey", F.round(twice("c_acctbal"), 4).alias("v"))


@frame("udtf_python", "SELECT n_nationkey, unnest(range(CAST(n_regionkey AS BIGINT))) AS i FROM nation")
def udtf_python(spark: SparkSession, sf: str) -> DataFrame:
    @F.udtf(returnType=StructType([StructField("i", LongType())]))
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    return table(spark, sf, "nation").lateralJoin(Count(F.col("n_regionkey").outer())).select("n_nationkey", "i")


@frame("prepared_statement", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def prepared_statement(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000, "status": "F"})


@frame("catalog_columns", "SELECT column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name = 'nation'")
def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark)
    t.replace("nation", table(spark, sf, "nation"))
    return t.describe("nation").select(F.col("col_name").alias("name"), F.col("data_type").alias("kind"))


# streams
@frame("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.tumbling(s, "at", "1 day", "0 seconds", "event_type", "value"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@frame("stream_join", "SELECT a.event_id AS view_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("vt"))
    buys = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp")).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("at").alias("bt"))
    return jobs.run_to_table(jobs.interval_join(views, buys, "user_id", "vt", "bt", "'1' HOUR", "40 days").select("view_id", "buy_id"))


@frame("stream_sliding_count", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id")
def stream_sliding_count(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.read_table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "click").cast("int").alias("hit"))
    return jobs.run_to_table(jobs.sliding_count(s, "user_id", "hit", "event_id", 10), "update")


@frame("stream_change_feed", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    out = shared_dir(spark)
    jobs.change_feed(jobs.read_table(spark, sf, "events"), lambda batch, number: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return spark.read.schema("event_type string, n long").parquet(f"{out}/batch=*").groupBy("event_type").agg(F.sum("n").alias("n"))


@frame("stream_append_late", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1 HAVING CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_append_late(spark: SparkSession, sf: str) -> DataFrame:
    """Append mode: a day comes out once, when the watermark, a day behind, has passed its end."""
    s = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.windowed(s, "at", F.window("at", "1 day"), "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@frame("stream_sliding_window", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - k * INTERVAL 1 DAY AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def stream_sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.windowed(s, "at", F.window("at", "2 days", "1 day"), "0 seconds"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@frame("stream_session_window", "WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)")
def stream_session_window(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that a gap of six hours has closed before the watermark."""
    s = jobs.read_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.windowed(s, "at", F.session_window("at", "6 hours"), "0 seconds", "user_id"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# documents, change logs, catalog and procedures
@frame("doc_find_more", f"SELECT event_id FROM events WHERE coalesce({_K} <> 7, true) AND {_K} IN (5, 6, 7, 8) AND json_extract_string(props, '$.none') IS NULL")
def doc_find_more(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_find(table(spark, sf, "events"), "props", {"k": {"$ne": 7, "$in": [5, 6, 7, 8]}, "none": {"$exists": False}}).select("event_id")


@frame("doc_update", f"SELECT event_id, CASE WHEN {_K} > 50 THEN 'high' END AS tag, CAST(CASE WHEN {_K} > 50 THEN {_K} + 5 ELSE {_K} END AS BIGINT) AS k, CASE WHEN {_K} > 50 THEN 1 END AS made FROM events")
def doc_update(spark: SparkSession, sf: str) -> DataFrame:
    d = A.doc_update(table(spark, sf, "events"), "props", {"k": {"$gt": 50}}, {"$set": {"tag": "high", "gone": 1}, "$inc": {"k": 5, "made": 1}, "$unset": {"gone": ""}})
    return d.select("event_id", F.get_json_object("props", "$.tag").alias("tag"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.made").cast("int").alias("made"))


@frame("cdc_changes_since", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, row_number() OVER (ORDER BY s_suppkey) + (SELECT count(*) FROM supplier) AS seq, 'update' AS op FROM supplier WHERE s_acctbal <> 0 QUALIFY seq > (SELECT count(*) FROM supplier) + 2")
def cdc_changes_since(spark: SparkSession, sf: str) -> DataFrame:
    """All rows inserted, then all balances set to 0; the changes after the second of those."""
    s = _supplier(spark, sf)
    log = A.ChangeLog("s_suppkey")
    log.capture(s.limit(0), s)
    first = log.last
    log.capture(s, s.withColumn("s_acctbal", F.lit(0.0)))
    return log.changes(first + 2).select("s_suppkey", "seq", "op")


@frame("agg_result_cache", "SELECT o_orderstatus, count(*) AS n, CAST(1 AS BIGINT) AS hits FROM orders GROUP BY o_orderstatus")
def agg_result_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for twice, then once more after the table has changed: one answer comes from the cache."""
    cache, o = A.ResultCache(), table(spark, sf, "orders")
    ask = lambda: cache.get("by status", ("orders",), lambda: o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
    ask(), ask()
    cache.changed("orders")
    return ask().withColumn("hits", F.lit(cache.hits).cast("long"))


@frame("ddl_tables", "SELECT 'kept' AS name, count(*) AS n FROM region UNION ALL SELECT 'emptied', 0 UNION ALL SELECT 'more', 2 * count(*) FROM region")
def ddl_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Create, rename, insert, truncate and drop."""
    t, r = Tables(spark), table(spark, sf, "region")
    for name in ("quillon_a", "quillon_kept", "quillon_emptied", "quillon_more", "quillon_gone"):
        t.drop(name, if_exists=True)
    t.create("quillon_a", r)
    t.rename("quillon_a", "quillon_kept")
    t.create("quillon_emptied", r)
    t.truncate("quillon_emptied")
    t.create("quillon_more", r)
    t.insert("quillon_more", r)
    t.create("quillon_gone", r)
    t.drop("quillon_gone")
    left = [x for x in t.show().filter("table_name LIKE 'quillon\\_%' AND table_name NOT IN ('quillon_spent', 'quillon_sketches')").select("table_name").toPandas()["table_name"] if x in ("quillon_a", "quillon_kept", "quillon_emptied", "quillon_more", "quillon_gone")]
    parts = [spark.table(x).agg(F.lit(x.removeprefix("quillon_")).alias("name"), F.count(F.lit(1)).alias("n")) for x in sorted(left)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@frame("procedure_loops", "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(3 AS BIGINT) AS rounds FROM (SELECT n_nationkey AS n FROM nation WHERE n_regionkey < 3)")
def procedure_loops(spark: SparkSession, sf: str) -> DataFrame:
    """WHILE over regions with a FOR over a query inside."""
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    p = Routines(spark)
    p.create("sum_nations", [("most", "INT")], "DECLARE r INT DEFAULT 0; DECLARE total BIGINT DEFAULT 0; WHILE r < most DO FOR x AS SELECT n_nationkey FROM nation WHERE n_regionkey = r DO SET total = total + x.n_nationkey; END FOR; SET r = r + 1; END WHILE; SELECT total, CAST(r AS BIGINT) AS rounds")
    return p.call("sum_nations", 3)


@frame("procedure_call", "SELECT count(*) AS n, 'it''s F' AS said FROM orders WHERE o_orderstatus = 'F'")
def procedure_call(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    p = Routines(spark)
    p.create("count_orders", [("status", "STRING"), ("said", "STRING")], "SELECT count(*) AS n, any_value(said) AS said FROM orders WHERE o_orderstatus = status")
    return p.call("count_orders", "F", "it's F")


@frame("procedure_handler", "SELECT 'caught' AS state, count(*) AS n FROM region")
def procedure_handler(spark: SparkSession, sf: str) -> DataFrame:
    """A division by zero inside a block is caught by the block's handler, and the script goes on."""
    table(spark, sf, "region").createOrReplaceTempView("region")
    p = Routines(spark)
    p.create("careful", [], "DECLARE state STRING DEFAULT 'none'; BEGIN DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET state = 'caught'; END; SELECT 1 / 0; END; SELECT any_value(state) AS state, count(*) AS n FROM region")
    return p.call("careful")


@frame("procedure_catalog", "SELECT * FROM (VALUES ('a', 2::BIGINT, 'x INT, y STRING'), ('b', 0::BIGINT, '')) t(routine_name, n_parameters, parameters)")
def procedure_catalog(spark: SparkSession, sf: str) -> DataFrame:
    p = Routines(spark)
    p.create("a", [("x", "INT"), ("y", "STRING")], "SELECT x, y")
    p.create("b", [], "SELECT 1")
    p.create("c", [], "SELECT 2")
    p.drop("c")
    return p.catalog()


@frame("limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region) OFFSET 0")
def limit_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """The number comes from a query; a negative offset counts as 0."""
    return limited(table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey"), table(spark, sf, "region").agg(F.count(F.lit(1))), -3)


@frame("copy_tsv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    copy_to(table(spark, sf, "nation"), path, "tsv")
    return copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int", "tsv")


@frame("scan_pg_stats", "SELECT 'region' AS relname, count(*) AS n_live_tup FROM region UNION ALL SELECT 'orders', count(*) FROM orders")
def scan_pg_stats(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf, ["region", "orders"])
    names = [r.tablename for r in pg_tables(spark).filter("tablename IN ('region', 'orders')").collect()]
    return pg_stat_user_tables(spark, names)


@frame("source_dump_restore", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def source_dump_restore(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf, ["region", "nation"])
    path = shared_dir(spark)
    dump(spark, ["region", "nation"], path)
    restore(spark, ["region", "nation"], path)
    return spark.sql("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@frame("ddl_matview_manager", "SELECT 'counts' AS name, count(*) AS n FROM orders UNION ALL SELECT 'kept', 0 UNION ALL SELECT 'auto', count(*) FROM orders")
def ddl_matview_manager(spark: SparkSession, sf: str) -> DataFrame:
    """Views over a table that fills: a stale one is refreshed, one of another table stays, one refreshes itself."""
    source = [table(spark, sf, "orders").limit(0)]
    count = lambda: source[0].agg(F.count(F.lit(1)).alias("n"))
    m = D.ViewManager()
    m.create("counts", ["orders"], count)
    m.create("kept", ["region"], count)
    m.create("auto", ["orders"], count, auto_refresh=True)
    m.refresh_stale()
    source[0] = table(spark, sf, "orders")
    m.changed("orders")
    m.refresh_stale()
    parts = [m.read(n).select(F.lit(n).alias("name"), "n") for n in ("counts", "kept", "auto")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@frame("ddl_sequence_values", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) * 5 + 20 AS v FROM nation")
def ddl_sequence_values(spark: SparkSession, sf: str) -> DataFrame:
    s = Sequence(start=10, step=5)
    s.nextval(), s.nextval()
    s.setval(20)
    return s.take(table(spark, sf, "nation").select("n_nationkey"), ["n_nationkey"], "v")
