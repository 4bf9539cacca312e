import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleaner.runtime import clear_scratch, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", cores=8, partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    clear_scratch(spark)
    spark.stop()


@pytest.fixture
def column(spark):
    """Evaluate a one-column expression over Python values."""

    def run(values, expression, kind="STRING"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
        from pyspark.sql import functions as F

        done = rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in done]

    return run
