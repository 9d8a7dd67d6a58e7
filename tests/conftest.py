import os
import sys

import pytest

for folder in (os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))):
    sys.path.insert(0, folder)

from linkloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture
def strings(spark):
    """Column of strings named ``s`` from plain arguments."""

    def build(*values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")

    return build


@pytest.fixture
def apply(strings):
    """Evaluate a column builder over values, in order."""
    from pyspark.sql import functions as F

    def run(builder, *values):
        rows = strings(*values).select("i", builder(F.col("s")).alias("v")).orderBy("i").collect()
        return [r.v for r in rows]

    return run
