import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="basketlens-tests")
    yield s


@pytest.fixture(scope="session")
def small_tables(spark):
    from basketlens.sources.tables import RetailTables
    return RetailTables.from_test_tables(spark, SF_SMALL)
