"""Every registered engine query against its SQL."""

import pytest
from conftest import SF001, SF01
from oracle import connect, difference

from strandline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert not difference(spark, con, QUERIES[name], ORACLE_SQL[name], SF001)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["dedupe_lineitem_key"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan
    top = QUERIES["query_page"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
