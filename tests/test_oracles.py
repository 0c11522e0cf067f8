"""Every query against its DuckDB twin on the smallest tables; those without one must give rows."""

import pytest

from statutory.plans import catalog
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
#: Trains models; has tests of its own.
SLOW = {"train_stack", "train_baseline", "score_bills", "key_factors"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert difference(found, con, catalog.ORACLES[name]) is None
    else:
        assert not found.isEmpty()
