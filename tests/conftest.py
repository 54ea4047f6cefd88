import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from benchloom.operators import scans  # noqa: E402
from benchloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["one task", "many tasks"])
def limit(request, spark, monkeypatch):
    """Run a test with few partitions and long chunks, and again with many and short ones."""
    many = request.param == "many tasks"
    monkeypatch.setattr(scans, "CHUNK_ROWS", 7 if many else scans.CHUNK_ROWS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not many).lower())
    yield scans.CHUNK_ROWS
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(c) for c in r))
