import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dqspark.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("dqspark-tests", cores="8")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL
