"""Foreign tables, cursors, pages, file formats, scripts, and ordered, domain and range types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions import types as T
from quillon.functions.predicates import likely, unlikely
from quillon.operators.cursors import Cursor, page_by_key, page_by_offset
from quillon.operators.scans import shared_dir
from quillon.plans.registry import frame, sql
from quillon.session import table
from quillon.sources.foreign import ForeignData


@frame("source_foreign_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3")
def source_foreign_table(spark: SparkSession, sf: str) -> DataFrame:
    f = ForeignData(spark)
    f.create_server("lake", "parquet")
    f.create_table("far_nation", "lake", path=f"{sf}/nation.parquet")
    return f.query("far_nation", ["n_nationkey", "n_name"], "n_regionkey = 1", ["n_name"], 3)


def _round_trip(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = shared_dir(spark)
        d = table(spark, sf, "region")
        d.write.format(kind).save(path)
        return spark.read.format(kind).schema(d.schema).load(path)

    return run


for _kind in ("json", "orc", "parquet"):
    frame(f"source_{_kind}_round_trip", "SELECT r_regionkey, r_name FROM region")(_round_trip(_kind))


@frame("cursor_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 5")
def cursor_fetch(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey")
    c = Cursor(d)
    c.fetch(5)
    rows = c.fetch(5)
    c.close()
    return spark.createDataFrame(rows, d.schema)


@frame("page_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
def page_offset(spark: SparkSession, sf: str) -> DataFrame:
    return page_by_offset(table(spark, sf, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 10).select("c_custkey")


@frame("page_keyset", "SELECT c_custkey FROM customer WHERE c_custkey > 42 ORDER BY c_custkey LIMIT 10")
def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return page_by_key(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 42, 10)


@frame("procedure_script", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def procedure_script(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("BEGIN DECLARE s STRING DEFAULT 'F'; IF (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 0 THEN SET s = 'O'; END IF; SELECT count(*) AS n FROM orders WHERE o_orderstatus = s; END")


@frame("execute_immediate", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
def execute_immediate(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT count(*) AS n FROM orders WHERE o_totalprice > ?' USING 200000")


@frame("type_enum_order", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS BIGINT) AS r FROM orders")
def type_enum_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", T.enum_rank(F.col("o_orderstatus"), ["O", "P", "F"]).alias("r"))


@frame("type_domain", "SELECT p_partkey FROM part WHERE NOT (p_size > 0 AND p_size < 40)")
def type_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(~T.in_domain(F.col("p_size"), F.col("p_size") > 0, F.col("p_size") < 40)).select("p_partkey")


@frame(
    "type_range",
    "SELECT p_partkey, p_size <= 20 AND 20 < p_size + 10 AS has, p_size < 25 AND 15 < p_size + 10 AS meets, p_size + 10 = 15 OR 25 = p_size AS touches, greatest(p_size, 15) AS lo, least(p_size + 10, 25) AS hi FROM part",
)
def type_range(spark: SparkSession, sf: str) -> DataFrame:
    r, q = T.make_range(F.col("p_size"), F.col("p_size") + 10), T.make_range(F.lit(15), F.lit(25))
    both = T.range_intersection(r, q)
    return table(spark, sf, "part").select(
        "p_partkey", T.range_contains(r, F.lit(20)).alias("has"), T.range_overlaps(r, q).alias("meets"), T.range_adjacent(r, q).alias("touches"), both["lower"].alias("lo"), both["upper"].alias("hi")
    )


sql("fn_date_part", "SELECT event_id, CAST(date_part('month', ts) AS BIGINT) AS m FROM events", "SELECT event_id, date_part('month', ts) AS m FROM events")
sql("fn_json_minify", "SELECT to_json(parse_json('{ \"a\" : [1, 2] }')) AS j", "SELECT CAST(json('{ \"a\" : [1, 2] }') AS VARCHAR) AS j")


@frame("fn_json_quote", "SELECT doc_id, CAST(to_json(source || '\"\\' || chr(10)) AS VARCHAR) AS j FROM documents")
def fn_json_quote(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.json_quote(F.concat("source", F.lit('"\\\n'))).alias("j"))


@frame("fn_likely", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_retailprice < 1500")
def fn_likely(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(unlikely(F.col("p_size") > 40) & likely(F.col("p_retailprice") < 1500)).select("p_partkey")


sql("fn_json_nested_path", "SELECT get_json_object('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[1].b') AS x", "SELECT json_extract_string('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[1].b') AS x")
sql("agg_first_last_by", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_order FROM orders GROUP BY o_custkey")
sql("agg_ordered_list", "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), x -> x.o_orderkey), ',') AS ks FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS ks FROM orders GROUP BY o_custkey")
sql("win_ratio_to_total", "SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 8) AS share FROM part")
sql("win_running_distinct_days", "SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS d FROM events")
