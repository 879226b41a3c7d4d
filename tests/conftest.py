import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from metalint.session import local_session

    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def estate(spark):
    from sample_estate import estate_files

    from metalint.plans.estate import Estate

    return Estate(estate_files(spark))
