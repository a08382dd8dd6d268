import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from terravox.session import build_session, ship_package

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


SF = "/root/testdata/sf0.001"
