"""Every registered query of the library proper against its SQL, or for rows, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from huestrata.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
