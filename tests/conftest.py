import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from turnlab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("turnlab-tests", master="local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="turnlab-checkpoint-"),
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted plain rows of a DataFrame."""
    def key(row):
        return tuple((x is None, "" if x is None else str(type(x)), 0 if x is None else x) for x in row)

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted([tuple(r) for r in picked.collect()], key=key)
    return collect
