"""Every query of the engine against its SQL; queries without SQL return rows."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.compare import SMALL, connect, rows

#: Their result may be empty on the smallest tables.
MAY_BE_EMPTY = {"join17_similarity_join", "val8_formula", "val9_protected_rows", "set6_difference", "flt1_exact_match", "rel3_quality_regression"}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(con.sql(registry.ORACLES[name]).df())
    elif name not in MAY_BE_EMPTY:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
