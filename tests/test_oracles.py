"""Every registered query against its SQL, and the others for rows."""

from __future__ import annotations

import pytest

from ledgerline.plans import queries as _registered  # noqa: F401
from ledgerline.plans.registry import ORACLES, QUERIES

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["ticker", "total_score"] and 0 < found.count() <= 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
