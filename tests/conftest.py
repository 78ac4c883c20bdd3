import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sieveline.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("sieveline-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a Column function to a list of strings."""

    def run(function, texts):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").repartition(4)
        out = rows.select("i", function(F.col("c")).alias("o")).collect()
        return [r["o"] for r in sorted(out, key=lambda r: r["i"])]

    return run
