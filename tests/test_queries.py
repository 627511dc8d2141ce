"""Every query with SQL gives the same columns and rows as that SQL."""

import pytest

from labelforge.plans.queries import ORACLES, QUERIES
from tests.compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, got = spark_rows(QUERIES[name](spark, SF))
    assert sum(got.values()) > 0
    if name in ORACLES:
        want_names, want = oracle_rows(ORACLES[name], SF)
        assert names == want_names
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
