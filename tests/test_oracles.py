import pytest

from lexcask.registry import ORACLES, QUERIES

from .duck import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_upload_plan(spark, sf):
    rows = QUERIES["upload_plan"](spark, sf).collect()
    assert len({r["key"] for r in rows}) == len(rows)
    assert all(r["key"].startswith("raws/doc-") and r["key"].endswith(r["name"][r["name"].index(".") :]) for r in rows)


def test_entry_needs_nothing_else(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "answer"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
