import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import ODD, documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, []).cache()
