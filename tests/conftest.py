import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from featurescape.session import get_session

    scratch = tempfile.mkdtemp(prefix="fs-tests-", dir="/tmp")
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.local.dir": scratch,
                           "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                           "spark.default.parallelism": "4",
                           # what tasks really read, see tests/event_log.py
                           "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{scratch}",
                           "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="fs-case-", dir="/tmp")


SF = "/root/testdata/sf0.001"
