import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("lotwise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lotwise-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """60 unit rows of 5 features with labels +-1, as a frame and as NumPy arrays."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[rng.random(x.shape) < 0.3] = 0.0
    x[0] = [0.0, 0.0, 1.0, 0.0, 0.0]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = np.where(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, y double, features array<double>")
    return df, x, y
