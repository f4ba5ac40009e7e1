"""Every query of the engine against its DuckDB equivalent, over the smallest tables."""

from __future__ import annotations

import pytest
from conftest import compared

from proselens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    mine, other = compared(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)
    assert [tuple(map(plain, r)) for r in mine] == [tuple(map(plain, r)) for r in other]


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert registry.entry(spark, sf_dir).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
