"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - (set(entry.EXTRA) - set(entry.EXTRA_SQL))))
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["file_id", "total_rows", "valid_rows", "skipped_rows"]
    assert out.count() > 0
