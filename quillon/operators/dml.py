"""Data changes as functions from snapshots to snapshots, checks and materialized views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.operators.scans import shared_dir


def first_by_key(source: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The first row of each key by ``order`` (default: all columns), and every row without a key."""
    by = W.partitionBy(key).orderBy(*(order or source.columns))
    (mark,) = unused(source.columns, "r")
    return source.withColumn(mark, F.row_number().over(by)).filter((F.col(mark) == 1) | F.col(key).isNull()).drop(mark)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that are columns already."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def insert_values(target: DataFrame, rows: list[dict], defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT .. VALUES: rows by column name; a column that a row leaves out takes its default, or null."""
    defaults = defaults or {}
    parts = []
    for row in rows:
        unknown = set(row) - set(target.columns)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        value = lambda c, row=row: (row[c] if isinstance(row[c], Column) else F.lit(row[c])) if c in row else defaults.get(c, F.lit(None))
        parts.append(F.struct(*[value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns]))
    if not parts:
        return target.limit(0)
    return target.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def upsert(target: DataFrame, source: DataFrame, key: str, update: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT: DO NOTHING without ``update``, else DO UPDATE with columns of target (t) and source (excluded).

    Of source rows with equal keys the first by ``order`` (default: all columns)
    counts. A null key conflicts with nothing, so every such row is inserted.
    """
    s = first_by_key(source, key, order)
    new = s.join(target.select(key), key, "left_anti").select(*target.columns)
    if not update:
        return target.unionByName(new)
    return update_from(target, s, key, update, order, "excluded").unionByName(new)


def update_where(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE .. SET .. WHERE .. RETURNING *: the table afterwards, and the changed rows. A condition that is null changes nothing."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    changed = target.filter(hit).select(*[sets[c].alias(c) if c in sets else F.col(c) for c in target.columns])
    after = target.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])
    return after, changed


def delete_where(target: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE .. WHERE .. RETURNING *: the table afterwards, and the rows that went. A condition that is null deletes nothing."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return target.filter(~hit), target.filter(hit)


def update_from(target: DataFrame, source: DataFrame, on: str, sets: dict[str, Column], order: str | list[str] | None = None, name: str = "s") -> DataFrame:
    """UPDATE .. FROM: the first source row by ``order`` wins; rows without one stay."""
    (mark,) = unused([*target.columns, *source.columns], "hit")
    order = [order] if isinstance(order, str) else order
    first = first_by_key(source.filter(F.col(on).isNotNull()), on, order).withColumn(mark, F.lit(True))
    j = target.alias("t").join(first.alias(name), F.col(f"t.{on}") == F.col(f"{name}.{on}"), "left")
    return j.select(*[F.when(F.col(mark), sets[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in sets else F.col(f"t.{c}").alias(c) for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, on: str) -> DataFrame:
    """DELETE .. USING: an anti join."""
    return target.join(source.select(on), on, "left_anti")


def merge(target: DataFrame, source: DataFrame, key: str, matched: dict[str, Column], insert: bool = True, order: list[str] | None = None) -> DataFrame:
    """MERGE with WHEN MATCHED UPDATE and WHEN NOT MATCHED INSERT, by one full join; columns are those of t and s.

    Of source rows with equal keys the first by ``order`` (default: all columns)
    counts. Null keys match nothing: such target rows stay, such source rows are inserted.
    """
    in_t, in_s = unused([*target.columns, *source.columns], "in_t", "in_s")
    t, s = target.withColumn(in_t, F.lit(True)), first_by_key(source, key, order).withColumn(in_s, F.lit(True))
    j = t.alias("t").join(s.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full" if insert else "left")
    cols = []
    for c in target.columns:
        both = matched.get(c, F.col(f"t.{c}"))
        cols.append(F.when(F.col(in_t) & F.col(in_s), both).when(F.col(in_t), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return j.select(*cols)


def violations(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """key, rule: rows that break a check, in one pass; an unknown result breaks nothing."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


class GeneratedColumns:
    """Columns computed from others when rows are stored; a row can't bring a value of its own."""

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    def stored(self, rows: DataFrame) -> DataFrame:
        given = set(rows.columns) & set(self.columns)
        if given:
            raise ValueError(f"generated columns can't be given: {sorted(given)}")
        path = shared_dir(rows.sparkSession)
        made = rows.withColumns(self.columns)
        made.write.parquet(path)
        return rows.sparkSession.read.schema(made.schema).parquet(path)


class MaterializedView:
    """A stored query result with a note of whether its tables have changed since."""

    def __init__(self, query: Callable[[], DataFrame]):
        self.query, self.path, self.stale, self.rows = query, "", True, None

    def notify(self) -> None:
        self.stale = True

    def read(self) -> DataFrame:
        """The stored rows, computed anew if they are stale."""
        if self.stale or self.rows is None:
            df = self.query()
            self.path = shared_dir(df.sparkSession)
            df.write.parquet(self.path)
            self.rows, self.stale = df.sparkSession.read.schema(df.schema).parquet(self.path), False
        return self.rows


class ViewManager:
    """Materialized views by name, with the tables that each reads; a change makes those views stale, or computes them at once."""

    def __init__(self) -> None:
        self.views: dict[str, tuple[MaterializedView, frozenset[str], bool]] = {}

    def create(self, name: str, tables: list[str], query: Callable[[], DataFrame], auto_refresh: bool = False) -> None:
        if name in self.views:
            raise ValueError(f"view {name} exists")
        self.views[name] = (MaterializedView(query), frozenset(tables), auto_refresh)

    def changed(self, table: str) -> None:
        for view, tables, auto in self.views.values():
            if table in tables:
                view.notify()
                if auto:
                    view.read()

    def stale(self) -> list[str]:
        return [n for n, (v, _, _) in self.views.items() if v.stale]

    def refresh_stale(self) -> list[str]:
        """Computes all stale views anew and names them."""
        names = self.stale()
        for n in names:
            self.views[n][0].read()
        return names

    def read(self, name: str) -> DataFrame:
        return self.views[name][0].read()


def with_sequence(df: DataFrame, order: list[str], name: str, start: int = 1, step: int = 1) -> DataFrame:
    """Numbers without gaps in an order, without bringing all rows to one task.

    Rows are range-partitioned and stored; the row counts of the partitions, one
    number each, give every partition its first number.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    parts.write.parquet(path)
    stored = spark.read.schema(parts.schema).parquet(path)
    counts = stored.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return stored.join(before, "__p").withColumn(name, ((F.col("__b") + local - 1) * step + start).cast("long")).drop("__p", "__b")
