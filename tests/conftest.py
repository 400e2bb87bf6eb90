import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kestrel.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture
def rows():
    """Rows of a DataFrame as a set of tuples in the order of its columns; fails on repeats."""

    def get(df):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got))
        return set(got)

    return get
