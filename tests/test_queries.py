"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from textloom.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    expected = cur.fetchall()
    assert sorted(columns) == sorted(df.columns)
    number = lambda rows: [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x for x in r] for r in rows]
    assert normal(number(got), df.columns) == normal(number(expected), columns)
