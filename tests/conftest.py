import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pubsift.session import get_session

    ckpt = tempfile.mkdtemp(prefix="pubsift-test-ckpt-")
    s = get_session("local[4]", 4, app="pubsift-tests",
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"})
    yield s
    s.stop()
