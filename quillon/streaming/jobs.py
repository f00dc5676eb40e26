"""Structured Streaming counterparts: tumbling windows, stream-stream joins, sliding counts, change feeds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.scans import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's rows as a stream of micro-batches of so many files.

    A stream reads folders, so a table that is one file is found by a pattern.
    """
    path = f"{sf_dir}/{name}.parquet"
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path if folder else f"{sf_dir}/{name}.parque[t]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the rows it wrote.

    Each batch has a folder of its number, which a repeated batch writes anew, so no
    row comes twice. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    out, at = shared_dir(spark), shared_dir(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, key: str, value: str) -> DataFrame:
    """Sums and counts by event-time window and key; windows are given out once the watermark has passed them."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def windowed(stream: DataFrame, ts: str, window, late: str, *keys: str) -> DataFrame:
    """Counts by a sliding or session window and keys: start, end, keys, n."""
    w = stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, within: str, late: str) -> DataFrame:
    """Pairs of two streams with the same key whose times are at most ``within`` apart, right after left; state is bounded by watermarks."""
    a, b = left.withWatermark(lts, late), right.withWatermark(rts, late)
    cond = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(rts) >= F.col(lts)) & (F.col(rts) <= F.col(lts) + F.expr(f"INTERVAL {within}"))
    return a.alias("l").join(b.alias("r"), cond)


def sliding_count(stream: DataFrame, key: str, flag: str, order: str, size: int) -> DataFrame:
    """For each key, how many of its last ``size`` rows have the flag, given out with every batch that has rows of it.

    Rows count in the order of arrival; ``order`` sorts those of one batch only.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(order)[flag].astype(int).tolist()
        kept = ([int(x) for x in state.get[0]] if state.exists else []) + rows
        state.update(("".join(map(str, kept[-size:])),))
        yield pd.DataFrame({key: [k[0]], "recent": [sum(kept[-size:])]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, recent long", "bits string", "update", GroupStateTimeout.NoTimeout)


def change_feed(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch and its number to a sink, as a subscription to a change log does. A batch may come again after a failure, so sinks go by its number."""
    at = shared_dir(stream.sparkSession)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
