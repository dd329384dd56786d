import __spark_entry__ as entry


def test_contract(spark, sf_dir):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).columns == ["user_id", "s1_event_id", "s2_event_id", "s3_event_id"]
