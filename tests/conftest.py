import numpy as np
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_points(spark, x, labels=None):
    rows = [
        (i, [float(v) for v in p], None if labels is None else int(labels[i]))
        for i, p in enumerate(x)
    ]
    return spark.createDataFrame(rows, "row_id bigint, point array<double>, cluster_id int")


@pytest.fixture
def blobs():
    """Three groups of 30 points and ten far noise points, fixed seed."""
    rng = np.random.default_rng(7)
    groups = [rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (8, 0), (0, 8))]
    noise = rng.uniform(-40, 40, (10, 2))
    return np.vstack([*groups, noise])
