"""Tables by name: information schema, descriptions, comments, and statements that create, empty, rename and drop them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES_SCHEMA = "table_name string, table_type string, comment string"
COLUMNS_SCHEMA = "table_name string, column_name string, ordinal_position long, data_type string, is_nullable string"


def information_tables(spark: SparkSession) -> DataFrame:
    """One row for each table and view of the session's catalog."""
    rows = [(t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE", t.description) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, TABLES_SCHEMA)


def information_columns(spark: SparkSession) -> DataFrame:
    """One row for each column of each table and view."""
    rows = []
    for t in spark.catalog.listTables():
        for i, f in enumerate(spark.table(f"`{t.name}`").schema, 1):
            rows.append((t.name, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO"))
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def pg_tables(spark: SparkSession) -> DataFrame:
    """schemaname, tablename and hasindexes; Parquet's statistics stand for indexes, so none is listed."""
    return information_tables(spark).select(F.lit("public").alias("schemaname"), F.col("table_name").alias("tablename"), F.lit(False).alias("hasindexes"))


def pg_stat_user_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """relname and n_live_tup, the rows of each table by counting them."""
    out = None
    for n in names:
        one = spark.table(n).agg(F.lit(n).alias("relname"), F.count(F.lit(1)).alias("n_live_tup"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "relname string, n_live_tup long")


def dump(spark: SparkSession, names: list[str], path: str) -> None:
    """Writes tables with their schemas to one folder each under a path."""
    for n in names:
        spark.table(n).write.parquet(f"{path}/{n}")


def restore(spark: SparkSession, names: list[str], path: str) -> None:
    """Names the tables of a dump again."""
    for n in names:
        spark.read.parquet(f"{path}/{n}").createOrReplaceTempView(n)


class Sequence:
    """NEXTVAL, CURRVAL and SETVAL for the driver; many values at once come from :func:`quillon.operators.dml.with_sequence`."""

    def __init__(self, start: int = 1, step: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False):
        if step == 0:
            raise ValueError("a step can't be 0")
        self.start, self.step, self.least, self.most, self.cycle = start, step, least, most, cycle
        self.next, self.current = start, None

    def nextval(self) -> int:
        v = self.next
        if self.most is not None and v > self.most or self.least is not None and v < self.least:
            if not self.cycle:
                raise ValueError("the sequence is at its end")
            v = (self.least if self.least is not None else self.start) if self.step > 0 else (self.most if self.most is not None else self.start)
        self.current, self.next = v, v + self.step
        return v

    def currval(self) -> int:
        if self.current is None:
            raise ValueError("no value has been taken yet")
        return self.current

    def setval(self, value: int, called: bool = True) -> int:
        self.current, self.next = value, value + self.step if called else value
        return value

    def take(self, df: DataFrame, order: list[str], name: str) -> DataFrame:
        """Numbers all rows in an order with the next values."""
        from quillon.operators.dml import with_sequence

        out = with_sequence(df, order, name, self.next, self.step)
        n = df.count()
        if n:
            self.setval(self.next + (n - 1) * self.step)
        return out


def show_create(spark: SparkSession, name: str) -> str:
    """A CREATE TABLE statement with the table's columns."""
    cols = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in spark.table(name).schema)
    return f"CREATE TABLE `{name}` (\n  {cols}\n)"


class Tables:
    """Stored tables under names of a session: files in the shared folder, each name a view of the newest ones.

    A statement writes a snapshot and moves the name to it, so readers of the old
    one are not disturbed and no lost executor leaves a half table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.comments: dict[str, str] = {}

    def create(self, name: str, rows: DataFrame, if_not_exists: bool = False) -> DataFrame:
        """CREATE TABLE .. AS; an error if the name is taken, or nothing with ``if_not_exists``."""
        if self.spark.catalog.tableExists(name):
            if if_not_exists:
                return self.spark.table(name)
            raise ValueError(f"table {name} exists")
        return self.replace(name, rows)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        from quillon.operators.recursion import written

        written(rows).createOrReplaceTempView(name)
        return self.spark.table(name)

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        return self.replace(name, self.spark.table(name).unionByName(rows))

    def truncate(self, name: str) -> DataFrame:
        return self.replace(name, self.spark.table(name).limit(0))

    def rename(self, name: str, new: str) -> DataFrame:
        if self.spark.catalog.tableExists(new):
            raise ValueError(f"table {new} exists")
        self.spark.table(name).createOrReplaceTempView(new)
        self.drop(name)
        return self.spark.table(new)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not self.spark.catalog.dropTempView(name) and not if_exists:
            raise ValueError(f"no table {name}")
        self.comments.pop(name, None)

    def comment(self, name: str, text: str) -> None:
        self.comments[name] = text

    def describe(self, name: str) -> DataFrame:
        """DESCRIBE: column, type, and whether it takes nulls."""
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.spark.table(name).schema]
        return self.spark.createDataFrame(rows, "col_name string, data_type string, nullable boolean")

    def show(self) -> DataFrame:
        """SHOW TABLES, with comments."""
        return information_tables(self.spark).withColumn("comment", F.create_map(*[F.lit(x) for kv in self.comments.items() for x in kv])[F.col("table_name")] if self.comments else F.col("comment"))


class RowPolicies:
    """Row-level security: for each table, which rows a role sees. A role without a policy sees none once the table has any."""

    def __init__(self) -> None:
        self.policies: dict[str, dict[str, list]] = {}

    def add(self, table: str, role: str, using) -> None:
        self.policies.setdefault(table, {}).setdefault(role, []).append(using)

    def read(self, table: str, rows: DataFrame, role: str) -> DataFrame:
        if table not in self.policies:
            return rows
        seen = F.lit(False)
        for using in self.policies[table].get(role, []):
            seen = seen | F.coalesce(using, F.lit(False))
        return rows.filter(seen)
