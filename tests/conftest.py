from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from perkline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
