import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import build, prepare

    session = prepare(build(4, 4, "6g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
