import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from wardline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
T = 1704067200000  # 2024-01-01 00:00:00 UTC


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Events from (seq, key, type, amount, ts); the key is both card and actor."""

    def build(rows):
        frame = spark.createDataFrame(
            rows, "seq long, cardId string, type string, amount double, ts long")
        return frame.selectExpr("*", "cardId AS actor", "timestamp_millis(ts) AS event_time")

    return build
