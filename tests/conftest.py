import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callgauge.session import local_session, prepare  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return prepare(local_session("4", shuffle_partitions=4, memory="4g"))


@pytest.fixture(scope="session")
def folder():
    return SMALL
