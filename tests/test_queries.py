"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from docspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cur = db.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cur.fetchall())
