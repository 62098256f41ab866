"""Every query with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tarn.plans import catalogue


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str([plain(y) for y in x])
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, duck):
    ours, theirs = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
