import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark("local[4]", 4, app_name="quarry-tests",
                  extra={"spark.driver.memory": "4g",
                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-test-ckpt-")})
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="quarry-test-")
