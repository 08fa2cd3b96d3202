import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from storelake.session import checkpoint_dir, get_session
    s = get_session("local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def registry():
    from storelake.plans.registry import load_all
    return load_all()
