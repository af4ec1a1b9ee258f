"""Every registered query with SQL gives the rows of its SQL."""

import pytest
from conftest import SMALL, rows_of

from lectern.plans import dialect_queries, page_queries, record_queries, reference_queries, repair_queries, scan_queries, search_queries, sink_queries, study_queries, text_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
