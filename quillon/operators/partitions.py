"""Tables partitioned by range, list or hash of a column, read with pruning."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.operators.scans import shared_dir

PART = "__part"


class Partitioned:
    """Rows in one folder for each partition; a read names the partitions that can hold what it asks for, and opens no other."""

    def __init__(self, spark: SparkSession, column: str, number: Column):
        self.spark, self.column, self.number = spark, column, number
        self.path, self.schema = "", None

    def write(self, rows: DataFrame) -> Partitioned:
        self.path, self.schema = shared_dir(self.spark), rows.schema
        rows.withColumn(PART, self.number).write.partitionBy(PART).parquet(self.path)
        return self

    def read(self, partitions: Sequence[int] | None = None) -> DataFrame:
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField(PART, IntegerType())])).parquet(self.path)
        if partitions is not None:
            stored = stored.filter(F.col(PART).isin(*partitions) if partitions else F.lit(False))
        return stored.drop(PART)


class RangePartitioned(Partitioned):
    """Partition i has values from bounds[i - 1] up to, not including, bounds[i]; nulls are in the first."""

    def __init__(self, spark: SparkSession, column: str, bounds: list):
        self.bounds = sorted(bounds)
        number = F.lit(0)
        for b in self.bounds:
            number = number + F.coalesce((F.col(column) >= F.lit(b)).cast("int"), F.lit(0))
        super().__init__(spark, column, number)

    def between(self, low: object, high: object) -> DataFrame:
        """Rows with low <= value <= high."""
        a, z = bisect.bisect_right(self.bounds, low), bisect.bisect_right(self.bounds, high)
        return self.read(range(a, z + 1)).filter(F.col(self.column).between(F.lit(low), F.lit(high)))


class HashPartitioned(Partitioned):
    """Partition by a hash of the value, so that an equality reads one."""

    def __init__(self, spark: SparkSession, column: str, parts: int):
        self.parts = parts
        super().__init__(spark, column, self.of(F.col(column)))

    def of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.parts)).cast("int")

    def equal(self, value: object) -> DataFrame:
        kind = next(f.dataType for f in self.schema if f.name == self.column)
        (part,) = self.spark.range(1).select(self.of(F.lit(value).cast(kind))).first()
        return self.read([part]).filter(F.col(self.column) == F.lit(value))
