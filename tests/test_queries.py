"""Every registered query against DuckDB."""

import pytest

from rowtide.plans import CATALOG
from tests.compare import assert_same, duck

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_matches_sql(spark, oracle, name):
    assert_same(CATALOG[name].run(spark, SF_DIR), oracle, CATALOG[name].sql)
