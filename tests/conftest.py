import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablescope-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mix12(spark):
    """Twelve rows with nulls, a constant column and an outlier."""
    x = [float(i) for i in range(1, 12)] + [100.0]
    y = [2.0 * i for i in range(1, 11)] + [None, 24.0]
    g = ["a", "a", "a", "b", "b", "b", "c", "c", "c", "c", None, "a"]
    h = ["p", "q", "p", "q", "p", "q", "q", "q", "q", "p", "p", "p"]
    rows = [(i + 1, x[i], y[i], 5, g[i], h[i]) for i in range(12)]
    return spark.createDataFrame(rows, "id int, x double, y double, k int, g string, h string")


def by(df, *keys):
    """Rows as dicts, addressed by one or more key columns."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = row.asDict()
    return out
