"""Every registered query of the engine against its SQL."""

import pytest

from lethe.plans import catalogue

from .support import TESTDATA, assert_matches


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_matches(catalogue.QUERIES[name](spark, TESTDATA), TESTDATA, catalogue.ORACLE_SQL[name])


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
