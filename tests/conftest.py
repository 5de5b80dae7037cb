import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cadenza.session import build

    session = build("local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_driver_memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
