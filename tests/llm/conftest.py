import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from edges import CLASHING, EDGES  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*row, *["x"] * len(CLASHING)) for row in EDGES], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def texts():
    """Random words with a seed."""
    rng = random.Random(7)
    return lambda n, vocabulary=400: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
