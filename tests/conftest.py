import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, memory="4g", app="quern-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
