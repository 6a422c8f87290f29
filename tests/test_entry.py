import __spark_entry__ as se
from habitnet.plans.oracle import SQL
from habitnet.plans.queries import QUERIES


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["src", "dst"]
    assert df.count() > 0


def test_registry_consistent():
    assert set(QUERIES) <= set(se.queries()) and set(se.oracle_sql()) <= set(se.queries())
    q, o = QUERIES, {k: v for k, v in SQL.items() if k in QUERIES}
    assert set(o) <= set(q)
    rows_only = set(q) - set(o)
    assert not rows_only
