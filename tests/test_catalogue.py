"""Every catalogue query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from paddock.plans import catalogue, catalogue_files, catalogue_tools, streams, weekend_sql, weekends  # noqa: F401
from paddock.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiub" else float(v) if isinstance(v, (int, bool)) else str(v)
    return sorted((tuple(None if v is pd.NA or v is pd.NaT else plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(v)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
