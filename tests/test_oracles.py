import pytest

from taleweave.plans import queries as core
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, data, name):
    """Queries without SQL: what holds of their rows is tested elsewhere, here that they have some."""
    df = core.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
