"""Delimited files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def copy_to(df: DataFrame, path: str, kind: str = "csv", header: bool = True) -> None:
    """COPY TO: csv, tsv or text with ``\\N`` for nulls."""
    sep, null = {"csv": (",", ""), "tsv": ("\t", ""), "text": ("\t", "\\N")}[kind]
    df.write.csv(path, sep=sep, header=header, nullValue=null, emptyValue='""' if kind == "csv" else None)


def copy_from(spark: SparkSession, path: str, schema: str, kind: str = "csv", header: bool = True) -> DataFrame:
    """COPY FROM with a given schema; bad numbers and empty fields are null."""
    sep, null = {"csv": (",", ""), "tsv": ("\t", ""), "text": ("\t", "\\N")}[kind]
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=null, mode="PERMISSIVE")
