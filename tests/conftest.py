import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridmill.session import local_session

    return local_session(8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    """Result rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
