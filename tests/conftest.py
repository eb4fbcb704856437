import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from paths import ROOT  # noqa: E402

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from deliverylens.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="deliverylens-test-", dir="/tmp")
