from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parley.session import build_session, checkpoint_root

    s = build_session("local[8]", app_name="parley-tests", shuffle_partitions=8)
    checkpoint_root(s, tempfile.mkdtemp(prefix="parley-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="parley-test-")
