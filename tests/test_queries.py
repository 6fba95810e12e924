"""Every core query on the smallest data folder: against its SQL twin where it has one, else that it gives rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from lumenframe import queries
from lumenframe.plans import lookups, reports  # noqa: F401
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    compare(spark, db, FOLDER, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
