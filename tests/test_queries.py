import pytest

from cellweave.plans.queries import oracle_sql, queries
from oracle import compared


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, name):
    left, right = compared(spark, queries()[name], oracle_sql()[name])
    assert left == right


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
