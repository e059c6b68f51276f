"""The driver's contract."""

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_entry(spark):
    got = entry.entry(spark)
    assert {"alias", "kgid", "hop"} <= set(got.columns) and got.count() > 0
