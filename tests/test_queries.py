"""Every query against its SQL twin."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans import ORACLES, QUERIES
from tools.compare import compare

SF_DIR = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for f in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, name, SF_DIR)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
