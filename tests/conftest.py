import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture
def rows(spark):
    """Rows of a small DataFrame from DDL and tuples."""

    def make(ddl, *tuples):
        return spark.createDataFrame(list(tuples), ddl)

    return make


def as_set(df):
    return sorted(tuple(r) for r in df.collect())
