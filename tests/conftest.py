import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketclime.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Price rows from short tuples: ordinal, date, item, low, mode, high, quantity[, order_ok]."""
    from pyspark.sql import functions as F

    from marketclime.operators.quality import with_order_ok

    def make(*tuples):
        ddl = "ordinal long, d string, item string, price_low double, price_mode double, price_high double, quantity double"
        typed = [(*t[:3], *[None if v is None else float(v) for v in t[3:7]]) for t in tuples]
        df = spark.createDataFrame(typed, ddl)
        return with_order_ok(df.withColumn("date", F.col("d").cast("date")).drop("d").withColumn("unit", F.lit("kg")))

    return make
