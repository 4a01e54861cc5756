import os
import sys
import tempfile

import pytest

from testdata_paths import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session
    ckpt = tempfile.mkdtemp(prefix="ledgerlens-test-", dir="/tmp")
    s = build_session(master="local[*]", shuffle_partitions=8, app="ledgerlens-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wh(spark):
    from ledgerlens.config import TEST_PARAMS
    from ledgerlens.plans.warehouse import get_warehouse
    return get_warehouse(spark, SF_SMALL, TEST_PARAMS)
