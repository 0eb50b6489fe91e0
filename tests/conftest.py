import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cpelink.session import local_session, release_scratch
    s = local_session(4, app="cpelink-tests")
    yield s
    release_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
