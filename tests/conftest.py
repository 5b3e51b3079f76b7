import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(expression builder, *texts): the expression over one string column."""
    def run(make, *texts):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        return [r[0] for r in rows.select(make(F.col("x")).alias("y"), "i").orderBy("i")
                .select("y").collect()]
    return run
