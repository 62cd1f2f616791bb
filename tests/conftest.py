import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sievework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture
def one(spark):
    """Value of a column expression over a single literal text."""
    from pyspark.sql import functions as F

    def run(expression, text):
        return spark.range(1).select(F.lit(text).alias("t")).select(expression(F.col("t")).alias("v")).first().v

    return run
