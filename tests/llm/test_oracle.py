"""The SQL of those queries that have one, in DuckDB."""

from pathlib import Path

import pytest

from ternary_rules.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(tuple, df.select(*columns).collect()))
    assert mine and mine == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
