import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


_SHARED = tempfile.mkdtemp(prefix="lodestone-tests-")
# columns can only be built while a session is up, and test modules build some
_SESSION = build_session("tests", "local[8]", **{
    "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{_SHARED}/shared",
    "spark.sql.warehouse.dir": f"{_SHARED}/warehouse"})
_SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column over one row of strings."""
    def run(column, **texts):
        row = spark.range(1)
        from pyspark.sql import functions as F
        for name, text in texts.items():
            row = row.withColumn(name, F.lit(text))
        return row.select(column.alias("v")).first()["v"]
    return run


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
