import pytest

from oracle_check import compare, connect

from __spark_entry__ import TRAINING_QUERIES, entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - set(TRAINING_QUERIES)))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF) == []


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
    without = set(queries()) - set(oracle_sql()) - set(TRAINING_QUERIES)
    assert without == {"train_predict", "staged_update", "sector_samples"}
