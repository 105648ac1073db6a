import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))  # for the workers


@pytest.fixture(scope="session")
def spark():
    from pixelweave.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()
