import os

import pytest

import __spark_entry__ as contract
from check_oracles import difference, duck

FOLDER = "/root/testdata/sf0.001"
# The training-data queries have their own tests.
QUERIES = contract.registered.all_queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(contract.oracles.all_oracles())
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["google_url", "establishment_url", "scraped_item", "ingredients", "combined_score"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, FOLDER, QUERIES[name], contract.oracle_sql()[name]) == ""
