"""Stored procedures: SQL scripts with parameters, kept by name and run by CALL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Procedure:
    """A script between BEGIN and END; parameters are variables of it."""

    name: str
    parameters: tuple[tuple[str, str], ...]  # names and types
    body: str


class Routines:
    """A catalog of procedures. Bodies may use IF, CASE, WHILE, LOOP, REPEAT, FOR, handlers, SIGNAL and EXECUTE IMMEDIATE; the last query is the result."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.procedures: dict[str, Procedure] = {}

    def create(self, name: str, parameters: list[tuple[str, str]], body: str, replace: bool = False) -> None:
        if name in self.procedures and not replace:
            raise ValueError(f"procedure {name} exists")
        self.procedures[name] = Procedure(name, tuple(parameters), body.strip().rstrip(";"))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.procedures.pop(name, None) is None and not if_exists:
            raise ValueError(f"no procedure {name}")

    def call(self, name: str, *args: object) -> DataFrame:
        """Runs the procedure. Arguments are bound as values, so text in them is never read as SQL."""
        p = self.procedures.get(name)
        if p is None:
            raise ValueError(f"no procedure {name}")
        if len(args) != len(p.parameters):
            raise ValueError(f"{name} takes {len(p.parameters)} arguments")
        declared = "".join(f"DECLARE {n} {t} DEFAULT CAST({literal(v)} AS {t}); " for (n, t), v in zip(p.parameters, args))
        return self.spark.sql(f"BEGIN {declared}{p.body}; END")

    def catalog(self) -> DataFrame:
        rows = [(p.name, len(p.parameters), ", ".join(f"{n} {t}" for n, t in p.parameters)) for p in self.procedures.values()]
        return self.spark.createDataFrame(rows, "routine_name string, n_parameters long, parameters string")


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + re.sub(r"(['\\])", r"\\\1", str(value)) + "'"
