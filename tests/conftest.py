import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from rewardloom.session import local_session

    session = local_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """One-column frame of texts with an index."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "i int, text string")

    return make


@pytest.fixture
def evaluate(texts):
    """Values of a column builder over texts, in order."""

    def run(build, values):
        from pyspark.sql import functions as F

        rows = texts(values).select("i", build(F.col("text")).alias("v")).collect()
        return [r.v for r in sorted(rows, key=lambda r: r.i)]

    return run
