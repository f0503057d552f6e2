"""Every registered query against its SQL on the smallest driver tables.

``python tests/compare.py`` also demands rows; on these tables a few queries find none.
"""

import __spark_entry__ as entry
import pytest
from checks import registry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, QUERIES[name], ORACLES[name], FOLDER, need_rows=False) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
