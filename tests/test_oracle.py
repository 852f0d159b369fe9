"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks import all_checks
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_checks.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, all_checks.QUERIES[name], all_checks.ORACLES.get(name))
    assert result.startswith(("ok", "rows-only")), result
    spark.catalog.clearCache()


def test_every_query_has_a_known_oracle_status():
    assert set(all_checks.ORACLES) <= set(all_checks.QUERIES)
