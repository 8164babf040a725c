"""Every query against its SQL, and the entry points."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from meridia.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(rows):
    cell = lambda v: float(f"{v:.12g}") if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(cell(r[k]) for k in sorted(r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, data, duck):
    got = [r.asDict() for r in QUERIES[name](spark, data).collect()]
    out = duck.sql(ORACLE_SQL[name])
    want = [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]
    assert rounded(got) == rounded(want)


def test_every_query_has_sql_and_no_other():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
