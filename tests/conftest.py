import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from almanac.session import build_session

    session = build_session("local[4]", "almanac-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
