import pytest

import __spark_entry__ as entry
from gristmill.plans import queries as own

from .oracle import SF, same_rows


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, name):
    same_rows(own.QUERIES[name](spark, SF), own.SQL[name])


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_rows_only_queries_run(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "row_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
