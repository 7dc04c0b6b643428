import datetime as dt
import os
import tempfile

import pytest

from placewatch.session import local_session

NOW = "2026-05-12 06:00:00"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", memory="8g")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="placewatch-tests-"))
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="placewatch-", dir="/tmp")


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of plain tuples."""
    def get(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
    return get


def at(text):
    return dt.datetime.fromisoformat(text)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
