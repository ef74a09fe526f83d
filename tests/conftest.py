import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wheeltrace.session import local_session, release

    session = local_session(4)
    yield session
    release(session)  # the written steps of all tests


SF = "/root/testdata/sf0.001"
