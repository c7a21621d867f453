from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleanery.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a Column function on one text."""
    from pyspark.sql import functions as F

    def evaluate(f, *args):
        row = spark.createDataFrame([args], [f"c{i}" for i in range(len(args))])
        return row.select(f(*[F.col(c) for c in row.columns]).alias("v")).first()["v"]

    return evaluate
