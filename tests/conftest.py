from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("LEAFMARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from leafmark.session import session

    s = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return f"{TESTDATA}/sf0.001"
