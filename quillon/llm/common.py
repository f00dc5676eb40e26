"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the word of every contract, a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: the ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns, case aside."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that none can clash with those of an operator; ``select(name.*)`` unpacks it."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Where none is set, a session on a local master (tests) gets a temporary folder;
    on a cluster such a folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of each execution that starts in this block as soon as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage where a result is used several times or must not be
    computed anew in another way (loops, sizes that decide a plan). The files
    outlive executors, so a lost one costs only the tasks it was running. What
    the writing has shuffled goes once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by :func:`materialize`, when no plan that is still to run reads them."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Marks a materialized table of narrow rows for broadcast if it has at most ``max_rows``; else joins shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def running_sums(lengths: Column) -> Column:
    """For each element of an array of longs, the sum of those before it.

    Appending to an array copies it, so sums run over chunks of about the square
    root of the length, which keeps long arrays well under quadratic.
    """

    def within(part: Column, base: Column) -> Column:
        start = F.struct(base.cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])

    def chunked(c: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / c).cast("int") - 1), lambda g: F.slice(lengths, g * c + 1, c))

        def put(p: Column) -> Column:
            sums = F.transform(p, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))
            return let(within(sums, F.lit(0)), lambda bases: F.flatten(F.transform(p, lambda x, i: within(x, F.get(bases, i)))))

        return let(parts, put)

    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(lengths).cast("double")))).cast("int")
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).when(F.size(lengths) <= 64, within(lengths, F.lit(0))).otherwise(let(size, chunked))
