import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a Column function over a list of strings (or rows)."""

    def run(function, values, schema="v string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame(rows, schema).coalesce(1)
        return [r[0] for r in df.select(function(*[df[c] for c in df.columns]).alias("out")).collect()]

    return run
