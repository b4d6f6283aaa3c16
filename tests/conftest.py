import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import ensure_checkpoint_dir, get_session

    s = get_session(
        "local[4]", shuffle_partitions=4, extra_conf={"spark.ui.showConsoleProgress": "false"}
    )
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="riskloom-test-ckpt-"))
    yield s
    s.stop()
