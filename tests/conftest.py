import os
import sys
import tempfile

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))
for folder in (TESTS, os.path.dirname(TESTS)):
    if folder not in sys.path:
        sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark():
    from tallyman.session import local_session

    s = local_session("*")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyman-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from tallyman.sources.seed import seed_tables

    return seed_tables(spark)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tallyman-test-")
