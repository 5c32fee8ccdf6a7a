import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from objcat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inventory(spark):
    def make(*rows):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        return spark.createDataFrame(full, "path string, size long, mtime long, hash string")

    return make


@pytest.fixture(scope="session")
def value_of(spark):
    """Evaluate a function of one text column over given texts."""

    def evaluate(function, *texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        rows = df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()
        return [r["v"] for r in rows]

    return evaluate
