import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gapmeter.session import build_session
    ck = tempfile.mkdtemp(prefix="gm-test-ckpt-")
    s = build_session("local[4]", 4, "gapmeter-tests", {"spark.checkpoint.dir": ck})
    yield s
    s.stop()
