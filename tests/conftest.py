import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veritrove.session import session

    made = session(4, 4, "3g")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(DATA).exists():
        pytest.skip("test data is not here")
    return DATA
