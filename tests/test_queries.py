"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import oracle
from almanac.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert oracle.compare(spark, SF, QUERIES[name], ORACLES[name], con) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0
