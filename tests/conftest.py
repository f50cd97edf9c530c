import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corvane.session import get_session

    s = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__driver__memory="3g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="corvane-test-"), spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="corvane-wh-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
