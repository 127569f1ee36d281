from __future__ import annotations

import pytest

from broadsheet.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.sql.debug.maxToStringFields": "1000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of a column function over one text column, in input order."""

    def run(function, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        from pyspark.sql import functions as F

        out = rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
        return [r.o for r in out]

    return run
