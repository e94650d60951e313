"""Every query of the recording operators runs and equals its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from axonlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(canon(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(canon(r[c]) for c in names) for r in df.collect()), key=repr)
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == names
        at = [list(rel.columns).index(c) for c in names]
        assert rows == sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
