import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from kinegrid.session import session

    return session(cores=4, partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return str(TESTDATA / "sf0.001")
