import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from msgpulse import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session.build("tests", "local[8]", 4)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def golden(spark):
    """Six messages that exercise the label codes, a duplicate id and a missing body."""
    rows = [
        ("1", "up we go", "u1", "2020-12-29 23:59:59", 1, "StockTwits", 2, 0, "AAPL"),
        ("2", "going down", "u2", "2020-12-30 00:00:00", 0, "StockTwits", 0, 1, "AAPL"),
        ("3", "no idea", "u3", "2020-12-29 10:00:00", -69, "FIQA", 0, 0, "AAPL"),
        ("4", "who knows", "u4", "2020-12-29 11:00:00", None, "Twitter", 0, 0, "MSFT"),
        ("1", "later copy", "u9", "2020-12-31 00:00:00", 0, "StockTwits", 0, 0, "AAPL"),
        ("5", None, "u5", "2020-12-29 12:00:00", 1, "StockTwits", 0, 0, "AAPL"),
    ]
    from msgpulse.schema import conform

    return conform(
        spark.createDataFrame(
            rows,
            "id string, body string, author string, created_at string, sentiment int, source string, "
            "likes long, replies long, ticker string",
        )
    )
