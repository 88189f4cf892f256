from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session

    s = build_session("local[4]", 4, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def make_frame(spark):
    def _make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return _make
