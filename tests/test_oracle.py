"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import compare
import pytest

from lectern.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    result = compare.compare(spark, con, FOLDER, name)
    assert result.startswith(("ok", "rows-only")), result


def test_registry_is_complete():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert not [n for n in catalog.QUERIES if n.startswith("op")]
