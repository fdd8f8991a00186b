import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from carespark.plans.session import local_session

    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(folder):
    from gate.check import duck

    return duck(folder)


@pytest.fixture
def rows():
    """Sorted tuples of a frame."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
