import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SOURCE_SCHEMA = (
    "file_id long, file_ord long, repository string, path string, url string, raw_url string, content string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("keysieve-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Make a table of source files from (path, content) pairs."""

    def make(*pairs, repository="acme/app"):
        rows = [
            (i, i, repository, path, f"https://example.test/blob/{path}", f"https://example.test/raw/{path}", content)
            for i, (path, content) in enumerate(pairs, start=1)
        ]
        return spark.createDataFrame(rows, SOURCE_SCHEMA)

    return make
