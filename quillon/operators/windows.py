"""Frames that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def groups_frame(df: DataFrame, partition: list[str], order: str, start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end peer groups around the row's own.

    Peer groups are numbered by dense_rank; a RANGE frame over the numbers is the GROUPS frame.
    """
    w = W.partitionBy(*partition).orderBy(order)
    ranked = df.withColumn("__g", F.dense_rank().over(w))
    frame = W.partitionBy(*partition).orderBy("__g").rangeBetween(start, end)
    for name, agg in aggregates.items():
        ranked = ranked.withColumn(name, agg.over(frame))
    return ranked.drop("__g")


def exclude_current_row(df: DataFrame, partition: list[str], order: list[str], start: int, end: int, value: str, out: str) -> DataFrame:
    """Sum over a ROWS frame without the row itself: the sum less the row's value; null if nothing is left."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(start, end)
    n = F.count(value).over(w) - F.col(value).isNotNull().cast("int")
    return df.withColumn(out, F.when(n > 0, F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0))))


def exclude_peers(df: DataFrame, partition: list[str], order: str, tie: str, start: int, end: int, value: str, out: str, keep_self: bool, frame: str = "rows") -> DataFrame:
    """Count and minimum over a ROWS or RANGE frame without the row's peers; ``keep_self`` is EXCLUDE TIES, else EXCLUDE GROUP.

    A ROWS frame is gathered as an array, so its memory follows the frame's length;
    it must be bounded. ``tie`` orders rows inside a peer group. In a RANGE frame all
    peers see the same other groups, so groups are counted first and only they are framed.
    """
    if frame == "range":
        return _exclude_from_range(df, partition, order, start, end, value, out, keep_self)
    w = W.partitionBy(*partition).orderBy(order, tie).rowsBetween(start, end)
    gathered = df.withColumn("__a", F.collect_list(F.struct(F.col(order).alias("p"), F.col(tie).alias("t"), F.col(value).alias("v"))).over(w))
    own = (lambda x: x["t"] == F.col(tie)) if keep_self else (lambda x: F.lit(False))
    kept = F.filter("__a", lambda x: (x["p"] != F.col(order)) | own(x))
    gathered = gathered.withColumn("__k", kept)
    return gathered.withColumn(f"{out}_count", F.size("__k").cast("long")).withColumn(f"{out}_min", F.array_min(F.transform("__k", lambda x: x["v"]))).drop("__a", "__k")


def _exclude_from_range(df: DataFrame, partition: list[str], order: str, start: int, end: int, value: str, out: str, keep_self: bool) -> DataFrame:
    """One row per peer group with its rows and least value, framed without itself and joined back to the group's rows.

    Whole numbers frame the groups below and above by two ranges; of other orders the
    groups of a frame are gathered, so memory follows their number there.
    """
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate([*partition, order])]
    names = [f"__k{i}" for i in range(len(keys))]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__m"))
    w, at = W.partitionBy(*names[:-1]).orderBy(names[-1]), F.col(names[-1])
    if dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint"):
        sides = [w.rangeBetween(a, b) for a, b in ((start, min(end, -1)), (max(start, 1), end)) if a <= b]
        # Rows without an order value are one peer group and in no other's frame.
        n = [F.when(at.isNotNull(), F.sum("__n").over(s)) for s in sides]
        m = [F.when(at.isNotNull(), F.min("__m").over(s)) for s in sides]
    else:
        others = F.filter(F.collect_list(F.struct(at.alias("p"), F.col("__n").alias("n"), F.col("__m").alias("m"))).over(w.rangeBetween(start, end)), lambda x: x["p"] != at)
        n = [F.aggregate(others, F.lit(0).cast("long"), lambda s, x: s + x["n"])]
        m = [F.array_min(F.transform(others, lambda x: x["m"]))]
    nothing = F.lit(None).cast(groups.schema["__m"].dataType)
    framed = groups.select(*names, sum((F.coalesce(x, F.lit(0)) for x in n), F.lit(0).cast("long")).alias("__n"), F.least(*m, nothing, nothing).alias("__m"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*partition, order], names)]
    joined = df.join(framed, same)
    if keep_self:
        own = F.lit(start <= 0 <= end) | F.col(order).isNull()
        joined = joined.withColumns({"__n": F.col("__n") + own.cast("int"), "__m": F.when(own, F.least("__m", value)).otherwise(F.col("__m"))})
    return joined.withColumns({f"{out}_count": F.col("__n"), f"{out}_min": F.col("__m")}).select(*df.columns, f"{out}_count", f"{out}_min")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
