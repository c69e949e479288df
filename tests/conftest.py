import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxrisk.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "voxrisk-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column expression for each given string."""
    def run(expression, values):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame(list(enumerate(values)), "i INT, x STRING")
        return [r[1] for r in sorted(rows.select("i", expression(F.col("x"))).collect())]
    return run
