"""Every query of the library itself against its SQL, and the driver's contract."""

import pytest
from oracle import same_rows

from umbra import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf_dir, name):
    same_rows(plans.QUERIES[name](spark, sf_dir), plans.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(q) for q in e.queries().values())
