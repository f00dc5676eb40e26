"""One Spark session for all tests and helpers to hold frames against DuckDB."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillon.session import build_session

    s = build_session("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from quillon.session import TABLES

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(rows) -> list[tuple]:
    def one(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(x + 0.0)
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        if isinstance(x, (list, tuple)):
            return str([one(y) for y in x])
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


def held_against(spark, duck, query, oracle: str) -> None:
    """Same columns, same bag of rows."""
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = canonical(df.select(*[f"`{c}`" for c in cols]).collect())
    r = duck.execute(oracle)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == canonical(tuple(x[i] for i in at) for x in r.fetchall())
