import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rollcall.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, app="rollcall-tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return str(DATA / "sf0.001")

