"""Every registered query of the library's own operators agrees with its SQL."""

from __future__ import annotations

import pytest
from compare import DATA, same_rows

from tablemill.plans import catalog


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, f"{DATA}/sf0.01"), catalog.ORACLE_SQL[name], "sf0.01")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
