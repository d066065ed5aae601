"""Registered queries against their SQL.

On sf0.01 row positions order the rows of every claim totally; on the smaller data they do
not, so first and last values there are ties.
"""

from __future__ import annotations

import pytest
from compare import duck, duck_rows, spark_rows

from checks.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, connection, name):
    query, text = REGISTRY[name]
    got = spark_rows(query(spark, SF_DIR))
    assert got[0]
    if text is not None:
        assert got == duck_rows(connection, text)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
