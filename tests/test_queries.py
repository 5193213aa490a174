"""Every registered query against its SQL on the smallest given tables."""

import os

import duckdb
import pytest

from mnemos.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted("|".join(map(text, r)) for r in df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert df.columns
        return
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted("|".join(text(r[i]) for i in at) for r in want.fetchall())
