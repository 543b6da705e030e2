"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from seamlode.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_oracle(spark, views, name):
    df = registry.QUERIES[name](spark, DATA)
    want = views.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert name in registry.ORACLE
    got = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    assert got and got == sorted(repr([_plain(r[i]) for i in at]) for r in want.fetchall())
