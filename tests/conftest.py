from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from sqlassay.session import get_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("FATAL")
    shared_dir(session)
    yield session
    session.stop()
