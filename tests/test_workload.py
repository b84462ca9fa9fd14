"""Every query of the workload against its SQL in DuckDB."""

import math
from pathlib import Path

import pytest

from ternary_rules.plans.workload import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    def one(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = normal(df.select(*columns).collect())
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    theirs = normal(found.fetchall())
    assert mine, name
    assert len(mine) == len(theirs)
    assert mine == theirs
