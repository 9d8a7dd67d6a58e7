import hashlib
import random

import pytest


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """Write a table of rows into a folder that a query can read."""

    def build(name, rows, schema, files=2):
        folder = str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return build


@pytest.fixture
def rng():
    return random.Random(7)


def sha256(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
