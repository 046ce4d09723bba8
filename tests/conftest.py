from __future__ import annotations

import pytest

from codeloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{folder}/shared", spark__sql__warehouse__dir=f"file://{folder}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
