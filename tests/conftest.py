from __future__ import annotations

import os

import pytest

from creditladder.session import local_session

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), app="tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    def folder(name: str) -> str:
        path = f"{DATA}/sf{name}"
        if not os.path.isdir(path):
            pytest.skip(f"no test data in {path}")
        return path

    return folder


@pytest.fixture
def frame(spark):
    """frame("a int, b string", [(1, "x"), ...])"""

    def make(schema: str, rows: list[tuple]):
        return spark.createDataFrame(rows, schema)

    return make
