import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fairgauge.session import get_session
    s = get_session(cores="*", shuffle_partitions=8, app="fairgauge-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SMALL


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle import duck
    return duck(SMALL)
