import pytest
from compare import assert_same, connect
from conftest import SF

from edgeloom.plans import catalog

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, str(SF)), con.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE) - {"graph_metrics_full"}))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.queries()[name](spark, str(SF))
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[-1] == "Class"
