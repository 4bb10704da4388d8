import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# the smallest scale repeats one splinter key, so rows cannot be told apart there
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from craquelure.session import local_session

    return local_session("8", shuffle_partitions=8, memory="8g")


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(scope="session")
def tables(spark, folder):
    from craquelure.sources.views import Tables

    return Tables(spark, folder)
