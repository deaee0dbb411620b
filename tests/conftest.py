import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dealspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "dealspan-tests")


@pytest.fixture
def one(spark):
    """Evaluate a column expression over literal values, one result per value."""

    def run(values, ddl, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
        rows = df.select("i", expression.alias("r")).orderBy("i").collect()
        return [r.r for r in rows]

    return run
