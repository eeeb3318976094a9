import os

import pytest

import __spark_entry__ as contract
from check_oracles import difference, duck
from trawlwork.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_registered():
    names = set(queries.all_queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert names | {"pipeline"} <= set(contract.queries())
    assert set(queries.all_oracles()) <= names


@pytest.mark.parametrize("name", queries.all_oracles())
def test_query_equals_sql(spark, name):
    assert difference(spark, duck(FOLDER), FOLDER, contract.queries()[name], contract.oracle_sql()[name]) == ""
