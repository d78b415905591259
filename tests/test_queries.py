"""Every registered query that has SQL gives DuckDB's rows on the smallest tables; the others give rows, and the same ones again."""

import os

import duckdb
import pandas as pd
import pytest

from fieldmark.plans import cohorts, graphs, links, matches, records, reports, stores, streams, training  # noqa: F401
from fieldmark.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or not (isinstance(v, (int, float)) or hasattr(v, "quantize")):
        return str(v)
    return f"{float(v):.9g}"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert rows and rows == sorted(tuple(cell(r[c]) for c in cols) for r in QUERIES[name](spark, sf).collect())
        return
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in out.fetchall())
