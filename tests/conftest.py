import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TIDEPOOL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidepool.session import get_session

    session = get_session("tests", "local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__sql__streaming__stopTimeout="30s")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
