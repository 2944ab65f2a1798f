import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 8, app_name="tallyspark-tests",
                    extra={"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8"})
    yield s


def pile(spark, rows, cols=("Card", "Operation Number", "Amt_Float", "Accounting_Ref", "source_file")):
    """Small literal pile; missing trailing values are null."""
    types = {"Amt_Float": "double"}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in cols)
    return spark.createDataFrame([tuple(r) + (None,) * (len(cols) - len(r)) for r in rows], schema)
