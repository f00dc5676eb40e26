"""Scans over partitioned, inherited, sampled and JSON data."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors reach: one in the checkpoint folder. Only on a local master without one, as in tests, a temporary folder is made."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


def partition_pruned(df: DataFrame, column: str, value: object) -> DataFrame:
    """Writes the rows partitioned by a column and reads one partition; the scan opens no other folder."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).filter(F.col(column) == F.lit(value))


def inherited(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """The parent's rows and those of its descendants; columns that a table lacks are null."""
    out = parent
    for c in children:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def sample_rows(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE BERNOULLI."""
    return df.sample(fraction=percent / 100, seed=seed)


NODE = StructType([StructField(n, StringType()) for n in ("key", "value", "type", "atom")] + [StructField(n, IntegerType()) for n in ("id", "parent")] + [StructField(n, StringType()) for n in ("fullkey", "path")])


def json_nodes(text: str | None, start: str, deep: bool):
    """key, value, type, atom, id, parent, fullkey and path of the nodes below a path, depth first; malformed text and a missing path give none.

    With ``deep`` the start itself and everything below, else its members, or itself if
    it has none. Containers have their JSON as value and no atom. Numbers count
    nodes from 0 in document order.
    """

    def kind(v: object) -> str:
        return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]

    try:
        at = json.loads(text)
        for step in re.findall(r"\.([^.\[]+)|\[(\d+)\]", start):
            at = at[step[0]] if step[0] else at[int(step[1])]
    except (TypeError, ValueError, KeyError, IndexError):
        return
    number, todo = 0, [(None, at, None, start, None, 0)]
    while todo:
        key, v, parent, full, path, depth = todo.pop()
        inner = isinstance(v, (dict, list))
        if deep or depth == 1 or depth == 0 and not inner:
            atom = None if inner or v is None else v if isinstance(v, str) else json.dumps(v)
            yield key, json.dumps(v, separators=(",", ":")) if inner else atom, kind(v), atom, number, parent if deep else None, full, path or start
        me, number = number, number + 1
        if inner and (deep or depth == 0):
            items = v.items() if isinstance(v, dict) else enumerate(v)
            below = [(str(k), x, me, f"{full}[{k}]" if isinstance(v, list) else f"{full}.{k}", full, depth + 1) for k, x in items]
            todo += reversed(below)


@F.udtf(returnType=NODE)
class JsonTree:
    def eval(self, text: str, start: str):
        yield from json_nodes(text, start, True)


@F.udtf(returnType=NODE)
class JsonEach:
    def eval(self, text: str, start: str):
        yield from json_nodes(text, start, False)


def json_each(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """The rows with each member of the object or array at a path of their JSON column; see :func:`json_nodes`."""
    return df.lateralJoin(JsonEach(F.col(column).outer(), F.lit(path)))


def json_tree(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """The rows with every node of their JSON column from a path on; see :func:`json_nodes`."""
    return df.lateralJoin(JsonTree(F.col(column).outer(), F.lit(path)))
