import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


def one(spark, sql_expr, **values):
    """Evaluate one SQL expression over a one-row frame of string columns."""
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.selectExpr(f"{sql_expr} AS r").collect()[0].r


def many(spark, sql_expr, column, items):
    """Evaluate ``sql_expr`` over a column holding each item; results in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, {column} string")
    return [r.r for r in df.selectExpr("i", f"{sql_expr} AS r").orderBy("i").collect()]
