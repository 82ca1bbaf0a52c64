"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestream.plans import catalog
from lodestream.plans.scripts import _values
from truths import TRUTHS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return None
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}"
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    return str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got.columns) > 0


def truth_sql(name):
    columns, written = TRUTHS[name]
    typed = [(c.split(":") + ["VARCHAR"])[:2] for c in columns.split(", ")]
    names, casts = ", ".join(f'"{c}"' for c, _ in typed), ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c, kind in typed)
    return f"WITH {_values('t', names, written)} SELECT {casts} FROM t"


@pytest.mark.parametrize("name", sorted(catalog.CORPUS_QUERIES))
def test_scripts_of_the_library(spark, duck, name):
    got = catalog.CORPUS_QUERIES[name](spark, SF).toPandas()
    sql = catalog.CORPUS_ORACLES.get(name) or (truth_sql(name) if TRUTHS.get(name, ("", []))[1] else None)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
    else:
        assert len(got.columns) > 0


def test_registered_queries_read_the_given_tables():
    assert not set(catalog.QUERIES) & set(catalog.CORPUS_QUERIES) and not set(TRUTHS) & set(catalog.QUERIES)
