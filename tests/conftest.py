import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tapegrid.plans.session import build_session
    s = build_session("tests", cores=4, shuffle=4, shared=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
