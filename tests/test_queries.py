"""Each query with an SQL counterpart gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from lorebase.plans import catalogue

SF = os.environ.get("LOREBASE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert columns == sorted(names) and got == want
