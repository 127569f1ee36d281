"""Every query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from broadsheet.plans.catalog import QUERIES
from checks.compare import compare, duck
from checks.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    if name in ORACLE:
        assert compare(spark, db, FOLDER, name, QUERIES[name], ORACLE[name]) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
