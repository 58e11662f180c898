from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from lexdrift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a ``Column -> Column`` function over Python strings."""
    def run(function, values, type_="string"):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {type_}")
        rows = df.repartition(4).select("n", function(df["v"]).alias("r")).collect()
        return [r["r"] for r in sorted(rows, key=lambda r: r["n"])]

    return run
