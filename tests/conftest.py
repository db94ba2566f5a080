import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    from quern.session import attach

    attach(session)
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Evaluates a column function on a list of single values."""

    def run(f, values, kind="string"):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
        return [r.y for r in df.select("k", f(df["x"]).alias("y")).orderBy("k").collect()]

    return run
