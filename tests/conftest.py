import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lodesieve.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("4", "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield s


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF
