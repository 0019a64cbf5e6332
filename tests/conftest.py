import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stratalake.session import get_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def collect(df, *columns):
        out = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))

    return collect


RAW_SALES = (
    "txn_id string, store_id string, product_id string, product_name string, category string, quantity int, "
    "unit_price decimal(10,2), payment_method string, customer_id string, transaction_time timestamp, _ingested_at timestamp"
)


@pytest.fixture
def raw_sales(spark):
    """Two good rows, one without quantity, one without price, one without id."""
    from datetime import datetime
    from decimal import Decimal

    when = datetime(2024, 1, 15, 10, 30)
    lines = [
        ("T001", "S001", "P001", "Widget", "electronics", 2, "10.00", "credit", "C001"),
        ("T002", "S001", "P002", "Gadget", "home", 3, "25.50", "cash", None),
        ("T003", "S002", "P003", "Nothing", "home", 0, "5.00", "debit", "C003"),
        ("T004", "S002", "P004", "Free", "home", 1, "0.00", "cash", "C004"),
        (None, "S003", "P005", "Lost", "home", 1, "1.00", "cash", "C005"),
    ]
    return spark.createDataFrame(
        [(*line[:6], Decimal(line[6]), *line[7:], when, when) for line in lines], RAW_SALES
    )
