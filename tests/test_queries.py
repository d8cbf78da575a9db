"""Every registered query with SQL gives what DuckDB gives."""

import duckdb
import numpy as np
import pytest

from findery.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(df):
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(name, spark, sf, duck):
    got, want = canonical(queries.QUERIES[name](spark, sf).toPandas()), canonical(duck.execute(queries.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind in "fiu":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__

    assert 1 <= __spark_entry__.entry(spark).count() <= 10 * 200
