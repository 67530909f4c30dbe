import duckdb
import pytest

from quillon.llm.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR).select(*want.columns).collect()
    as_rows = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    rows = want.fetchall()
    assert as_rows(got) == as_rows(rows) and len(rows)
