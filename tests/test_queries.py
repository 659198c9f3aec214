"""Every query of the library's own operators against its SQL, and rows from those without."""

import pytest

from corpusloom.plans.registry import QUERIES, SQL
from oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
