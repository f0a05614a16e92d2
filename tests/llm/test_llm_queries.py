import pytest
from compare import assert_same, connect
from conftest import SF

from edgeloom.llm import registry

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, str(SF)), connect(SF).sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, str(SF)).count() > 0


def test_every_document_is_placed_and_scored(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    q = registry.queries()
    packed = q["p6_packed"](spark, str(SF))
    assert packed.groupBy("pack_id").agg({"doc_id": "count"}).count() == 3
    assert packed.select("pack_id", "doc_id").distinct().count() == 3 * n
    assert q["p8_scores"](spark, str(SF)).count() == n


def test_core_does_not_import_this_subpackage():
    from pathlib import Path

    import edgeloom

    root = Path(edgeloom.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "edgeloom.llm" in p.read_text()]
