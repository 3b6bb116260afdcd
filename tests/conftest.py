import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumenlog.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows and a DDL schema; text timestamps become timestamps."""
    from pyspark.sql import functions as F

    def build(rows, schema):
        names = [c.split()[0] for c in schema.split(",")]
        kinds = [c.split()[1] for c in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame(rows, raw)
        return df.withColumns({n: F.col(n).cast("timestamp") for n, k in zip(names, kinds) if k == "timestamp"})

    return build
