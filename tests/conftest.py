from __future__ import annotations

import os
import tempfile

import pytest

from edictal.session import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="edictal-tests-"))
    session = local_session(4, partitions=4, memory="6g")
    yield session
    session.stop()
