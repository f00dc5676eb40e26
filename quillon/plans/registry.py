"""All queries of the engine proper and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.session import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tables_in(sql: str) -> list[str]:
    """Tables whose names occur in the text; the others need no view."""
    import re

    from quillon.session import TABLES

    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def sql(name: str, spark_sql: str, oracle: str | None = None, check: bool = True) -> None:
    """Registers a query in Spark SQL; without ``oracle`` the same text also runs as the check."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables_in(spark_sql))
        return spark.sql(spark_sql)

    run.__name__ = name
    run.__doc__ = spark_sql
    QUERIES[name] = run
    if check:
        ORACLE[name] = oracle or spark_sql


def frame(name: str, oracle: str | None = None) -> Callable:
    """Decorator that registers a DataFrame query ``f(spark, sf_dir)``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


sql(
    "q_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")


MODULES = ["scans", "joins", "aggregates", "windows", "ctes", "tpch", "scalars", "library", "more"]
