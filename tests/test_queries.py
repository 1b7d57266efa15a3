import pytest
from compare import check

from lodespark.plans import catalog


@pytest.mark.parametrize("name", list(catalog.core_oracles()))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, catalog.core_queries()[name], catalog.core_oracles()[name])


@pytest.mark.parametrize("name", [n for n in catalog.core_queries() if n not in catalog.core_oracles()])
def test_query_without_sql_runs(spark, sf, name):
    rows = catalog.core_queries()[name](spark, sf)
    assert len(set(rows.columns)) == len(rows.columns) and rows.count() >= 0


def test_every_sql_has_a_query():
    assert set(catalog.core_oracles()) <= set(catalog.core_queries())
