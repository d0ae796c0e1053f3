import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wardline.session import checkpoint_dir, get_spark
    s = get_spark("local[*]", app="wardline-tests", shuffle_partitions=8)
    checkpoint_dir(s, local_default=True)   # tests only: the conf is unset locally
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wardline-test-")


SF_SMALL = "/root/testdata/sf0.001"
