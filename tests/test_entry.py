import os

import pytest

SF = "/root/testdata/sf0.001"


def test_names_and_flagship(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "delta_by_source" in q
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["per_example_delta", "judge_accuracy_delta", "chunk_roundtrip", "ledger_latest_valid", "stratified_cap"])
def test_some_queries_run(spark, name):
    from pairlens import catalogue

    rows = catalogue.QUERIES[name](spark, SF)
    assert rows.count() > 0
    if name == "chunk_roundtrip":
        assert rows.filter("not same").count() == 0
