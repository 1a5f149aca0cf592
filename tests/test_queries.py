"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from echotrail.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([_plain(r[c]) for c in columns]) for r in frame.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
