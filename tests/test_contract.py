"""Every registered query of the search-evaluation operators against its SQL on the smallest test tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v))
    return v.item() if hasattr(v, "item") else v


def rows(df):
    order = sorted(df.columns)
    got = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, r)) for r in df[order].itertuples(index=False, name=None)]
    return order, sorted(got, key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name in registry.oracles():
        assert rows(got) == rows(duck.execute(registry.oracles()[name]).fetch_df())
    else:
        assert len(got.columns) and len(got) > 0
