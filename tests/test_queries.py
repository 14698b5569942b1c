"""Every registered query of the library against its SQL, at the smallest scale."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, int | float | Decimal) else str(v)

    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(rows, got.columns) == canonical(expected, got.columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
