import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from sqltrail.session import build_session

    session = build_session(
        "sqltrail-tests",
        master="local[8]",
        **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
