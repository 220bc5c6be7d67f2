import glob
import os

import duckdb
import pytest
from hypothesis import settings

from folioscope.session import local_session

settings.register_profile("slow", deadline=None)
settings.load_profile("slow")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same_rows(left, right):
    """Both pandas frames hold the same rows, whatever their order."""
    assert sorted(left.columns) == sorted(right.columns)

    def cell(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))

    assert rows(left) == rows(right)
