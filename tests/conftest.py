import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from courtlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "courtlens-tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
