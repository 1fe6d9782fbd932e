"""Every registered query of the frame analytics against its SQL."""

import pytest
from conftest import SF, rows_of, rows_of_sql

from pulsegrid.plans import applied, oracles, queries, timeline

ORACLES, QUERIES = oracles.ORACLES | timeline.ORACLES | applied.ORACLES, queries.QUERIES | timeline.QUERIES | applied.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
