import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent), str(pathlib.Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from lakefind.session import local_session

    session = local_session(8, "lakefind-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
