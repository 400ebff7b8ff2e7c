import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from matloom.session import session

    s = session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    return s
