import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("PAGELIFT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pagelift.session import checkpoint_dir, local_session
    s = local_session(cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
