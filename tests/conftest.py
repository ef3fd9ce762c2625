import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larkspur.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Distinct sorted rows of a frame as tuples."""

    def collect(df):
        return sorted({tuple(r) for r in df.collect()}, key=repr)

    return collect
