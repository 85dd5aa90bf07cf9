"""Every registered query against its SQL."""

import oracle
import pytest

from __spark_entry__ import entry
from tableferry.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["o_orderkey", "o_totalprice", "o_orderpriority", "legacy_flag", "shipped_at", "line"]
    assert frame.count() > 0
