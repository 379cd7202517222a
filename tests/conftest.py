import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from vigilspark.session import local_session

    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vigilspark.plans.base import Tables

    return Tables(spark, SF)
