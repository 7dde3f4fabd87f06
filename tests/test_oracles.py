"""Every registered query against its SQL check on the smallest given tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check import compare  # noqa: E402

from evigraph.plans import catalog  # noqa: E402
from evigraph.plans.inputs import BASE_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    verdict = compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 100
