import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from claimcheck.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", memory="8g")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    ship_package(session)
    return session
