import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridlens.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hours(spark):
    """Builds (node, start_time, *values) rows, one per hour from a first hour on."""
    from datetime import datetime, timedelta

    def build(values, names="value double", node="A", first="2024-01-01 00:00:00"):
        begin = datetime.fromisoformat(first)
        rows = [
            (node, begin + timedelta(hours=i), *(v if isinstance(v, tuple) else (v,)))
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"node string, start_time timestamp_ntz, {names}")

    return build
