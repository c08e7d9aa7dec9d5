import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from listingloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Apply a column rule to literal texts and return what comes out, in order."""
    from pyspark.sql import functions as F

    def run(rule, values, *more):
        names = ["v", *(f"m{i}" for i in range(len(more)))]
        rows = [(i, *row) for i, row in enumerate(zip(values, *more))]
        schema = ", ".join(["i INT", *(f"{n} STRING" for n in names)])
        df = spark.createDataFrame(rows, schema)
        out = df.select("i", rule(*(F.col(n) for n in names)).alias("x")).orderBy("i")
        return [r["x"] for r in out.collect()]

    return run
