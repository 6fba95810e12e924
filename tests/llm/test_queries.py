"""The pN_ queries on the smallest data folder: against SQL where there is a twin, else that they give rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from lumenframe.llm import queries
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
    assert queries.QUERIES[name](spark, FOLDER).count() >= 0


@pytest.mark.parametrize("name", ["p7_clean_documents", "p8_clean"])
def test_clean_corpora_keep_all_columns(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(df.columns) == set(spark.read.parquet(f"{FOLDER}/documents.parquet").columns)
    assert df.where("text is not null").count() > 0
