import __spark_entry__ as E


def test_names_and_sql():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns and df.count() > 0
