import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sonalake import get_session

    conf = {"spark__ui__showConsoleProgress": "false", "spark__driver__memory": "4g", "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = get_session("local[4]", 4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
