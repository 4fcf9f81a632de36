import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from toolmill.session import build_session

    session = build_session("toolmill-tests", master="local[8]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a small literal table: ``rows(ddl, [tuples])``."""

    def make(ddl, values):
        return spark.createDataFrame(values, ddl)

    return make
