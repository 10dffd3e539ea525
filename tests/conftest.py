import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = check.session()
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return check.duck(SMALL)


@pytest.fixture
def rows(spark):
    """Build a DataFrame from literal rows."""

    def build(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return build
