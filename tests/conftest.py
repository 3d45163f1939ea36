import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tidemark-tests")
    yield session
    session.stop()


def rows(df):
    """Rows as a set-like sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
