import __spark_entry__ as entry


def test_queries_and_oracles_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p2_found" in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() > 0
