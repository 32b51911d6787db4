import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def tables(spark):
    from conftest_llm import SF

    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
