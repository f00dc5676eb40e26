"""One place for session settings and for reading the input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "quillon", cpus: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own.

    Only settings that change results are pinned (UTC, ANSI); AQE picks the
    shuffle partition sizes, so the number given here is just an upper bound.
    """
    n = cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.driver.memory", os.environ.get("QUILLON_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Nothing is cached: pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | tuple[str, ...] = tuple(TABLES)) -> None:
    """Registers temp views named as the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
