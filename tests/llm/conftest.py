import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, extra array<int>"


@pytest.fixture(scope="session")
def documents(spark):
    """A table from ``(doc_id, text)`` pairs, with a column that operators only pass on."""
    return lambda rows: spark.createDataFrame([(d, t, [1]) for d, t in rows], SCHEMA)
