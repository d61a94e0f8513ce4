"""Every query against its SQL twin, and the catalogue against the driver contract."""

import comparing
import pytest

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.01"
QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return comparing.connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    result = driver.entry(spark)
    assert result.columns == ["event_period", "posts", "avg_score", "avg_comments"]
    assert result.count() == 6


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    assert comparing.types_differ(result, duck, ORACLES[name]) == {}
    got, want = comparing.spark_table(result), comparing.duck_table(duck, ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
