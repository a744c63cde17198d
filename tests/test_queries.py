"""Every registered query against its DuckDB oracle on the smallest supplied tables, and the
driver entry point."""

import datetime as dt
import hashlib
import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from reelhouse import plans
from reelhouse.sources.fixtures import BASE_TABLES

from .conftest import SF_SMALL

NAMES = sorted(E.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for b in BASE_TABLES:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM read_parquet('{SF_SMALL}/{b}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "duration_seconds" in df.columns


def test_every_query_has_an_oracle_or_is_known():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    oracle = E.oracle_sql().get(name)
    if oracle is None:
        assert len(srows) > 0
        return
    cur = duck.execute(oracle)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)
