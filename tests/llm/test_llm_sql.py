"""Queries of this subpackage that SQL can express give the same rows in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    rounded = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
