import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from edgeloom.session import build_session

    s = build_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="session")
def tiny(spark):
    """a-b reciprocal, a triangle pair, a dead end, a second component, a self-loop."""
    e = [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d"), ("x", "y"), ("e", "e")]
    return spark.createDataFrame([*e, e[0], (None, "q"), ("q", None)], "Source string, Target string")
