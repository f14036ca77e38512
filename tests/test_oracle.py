"""Every query with an oracle matches DuckDB on the smallest driver tables."""

import hashlib
import math
import datetime

import duckdb
import pytest

import __spark_entry__ as E
from places import SF_SMALL
from pubsift.sources.tables import TABLES

ORACLES = E.oracle_sql()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    r = duck.execute(ORACLES[name])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["symbol", "n_docs", "n_sentences", "n_mentions", "first_date",
                          "first_pmid", "first_sent"]


def test_every_query_has_a_callable():
    qs = E.queries()
    assert len(qs) >= len(ORACLES)
    assert all(callable(f) for f in qs.values())
