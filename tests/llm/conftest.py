import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def hard(spark):
    from hard import documents, frame

    rows = documents()
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from hard import frame

    return frame(spark, [])
