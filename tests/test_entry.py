import __spark_entry__ as spark_entry
from meshframe.plans.oracle import ORACLE
from meshframe.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_flagship_runs(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["batch", "term", "value"] and df.count() == 3 * 10
