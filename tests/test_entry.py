import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    found = {r["kind"]: r["n"] for r in entry.entry(spark).collect()}
    assert {"missing_destination", "unexpected_destination", "mtime", "owner", "mode"} <= set(found)
