import os

import pytest
from oracle import compare

from skyloom.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_random_attributes_are_reproducible(spark):
    a = queries.QUERIES["random_attributes"](spark, SF)
    assert a.count() == 10_000
    assert a.repartition(3).exceptAll(queries.QUERIES["random_attributes"](spark, SF)).count() == 0
