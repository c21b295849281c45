import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from stancelake.session import build_session

    s = build_session("tests", "local[4]", 4, driver_memory="4g")
    yield s
    s.stop()
