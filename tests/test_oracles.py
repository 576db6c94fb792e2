"""Spark vs DuckDB on the registered queries (the driver's correctness gate, run locally)."""
import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from logweave.sources.tables import BASE_TABLES

from .conftest import SF


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in recs], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("qid", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, qid):
    df = E.queries()[qid](spark, SF)
    s = _rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(E.oracle_sql()[qid])
    d = _rows([x[0] for x in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in r.description)
    assert s == d


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "bucket_start"
