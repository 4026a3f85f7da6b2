"""Every registered query against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect
from checks.suite import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert compare(spark, tables, name, SF_DIR).startswith("ok")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_flagship_query(spark):
    assert entry_points.entry(spark).count() > 0
