from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from venuematch.session import tuned


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        tuned(SparkSession.builder.master("local[8]"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
