import os
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from partsmith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def t(spark):
    from partsmith.catalog import registry  # noqa: F401
    from partsmith.catalog.tables import tables

    return tables(spark, SF)
