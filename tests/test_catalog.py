import pytest

from sparkweave import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
