"""Every query that has an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from heronry.plans import catalog

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return "\0"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 8) + 0.0)
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(plain(v) for v in x) + "]"
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0
