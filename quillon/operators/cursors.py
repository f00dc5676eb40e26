"""Cursors and pages over a result."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Row


class Cursor:
    """DECLARE, FETCH and CLOSE: partitions come to the driver one at a time, as rows are fetched."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator(prefetchPartitions=False)

    def fetch(self, n: int = 1) -> list[Row]:
        return list(itertools.islice(self._rows, n))

    def close(self) -> None:
        self._rows = iter(())


def page_by_offset(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def page_by_key(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next rows behind a key; the range condition reaches the scan, so far pages cost no more than near ones."""
    return (df if after is None else df.filter(df[key] > after)).orderBy(key).limit(size)


def limited(rows: DataFrame, n: DataFrame | int | None, offset: int = 0) -> DataFrame:
    """LIMIT by a number, a query of one number, or ALL (None), after an offset; a negative offset is 0."""
    if isinstance(n, DataFrame):
        first = n.first()
        n = None if first is None else first[0]
    out = rows.offset(max(0, offset)) if offset > 0 else rows
    return out if n is None else out.limit(max(0, int(n)))
