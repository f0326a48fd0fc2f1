import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from textloom.scratch import drop_local_folders
    from textloom.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    drop_local_folders()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
