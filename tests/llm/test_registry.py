import os

import duckdb
import pytest

import __spark_entry__ as entry
from habitnet.llm import oracle, queries
from tools.oracle_check import TABLES, digest

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(oracle.SQL) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    assert rows or name == "op2_decontaminate"
    if name in oracle.SQL:
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(p := f"{SF_DIR}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        want = con.execute(oracle.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(frame.columns)
        assert digest(frame.columns, rows)[0] == digest(columns, want.fetchall())[0]
