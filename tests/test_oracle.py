"""Every registered query of the engine proper against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from quillon.plans import registry
from tests.conftest import SF, held_against

registry.load()
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLE))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    held_against(spark, duck, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_oracle_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_oracle_keys_are_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
