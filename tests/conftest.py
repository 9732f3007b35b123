import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from ledgermatch.session import get_spark, checkpoint_dir
    s = get_spark("local[4]", 4, app_name="ledgermatch-tests")
    checkpoint_dir(s)
    yield s
    s.stop()
