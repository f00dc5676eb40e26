"""Foreign servers and tables over Spark's readers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class ForeignData:
    """Named servers (a reader's format and options) and tables on them (more options, and a schema where one is needed)."""

    spark: SparkSession
    servers: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    tables: dict[str, tuple[str, dict[str, str], str | None]] = field(default_factory=dict)

    def create_server(self, name: str, kind: str, **options: str) -> None:
        self.servers[name] = (kind, options)

    def create_table(self, name: str, server: str, schema: str | None = None, **options: str) -> None:
        self.tables[name] = (server, options, schema)

    def scan(self, name: str) -> DataFrame:
        server, options, schema = self.tables[name]
        kind, shared = self.servers[server]
        reader = self.spark.read.format(kind).options(**shared, **options)
        return (reader.schema(schema) if schema else reader).load()

    def query(self, name: str, columns: list[str] | None = None, where: str | None = None, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Columns and conditions go down to the reader as far as it can take them."""
        out = self.scan(name)
        if where:
            out = out.filter(where)
        if columns:
            out = out.select(*columns)
        if order_by:
            out = out.orderBy(*[F.col(c) for c in order_by])
        return out if limit is None else out.limit(limit)

    def import_schema(self, name: str) -> list[tuple[str, str]]:
        return self.scan(name).dtypes
