import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=2, app="strandloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.enabled", "false")  # small inputs: planning again costs more than it saves
    yield session
    session.stop()
