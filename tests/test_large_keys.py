"""Queries on keys as large as those of larger tables, against their SQL."""

import datetime
import re

import duckdb
import pytest

from meridia.operators import records
from meridia.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["signal_decode", "signal_dictionary_check"])
def test_frames_of_products_over_64_bits(name, spark, data, tmp_path):
    first = datetime.datetime(2024, 1, 1)
    ids = [0, 1, 99_999, 2_042_023, 2_042_024, 3_000_001, 5_999_999, 36_000_000, 4_000_000_007, (1 << 63) - 1]
    rows = [(i + k if i < 1 << 62 else i - k, first + datetime.timedelta(days=3 * k), 89_999 * k + k, "view", 1.0, "{}") for i in ids for k in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{data}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in ("events", "nation"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    out = con.sql(ORACLE_SQL[name])
    got = sorted((tuple(r[c] for c in out.columns) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(out.fetchall(), key=repr)
    assert len(got) > 50


def dealt_to(frame):
    """Numbers of partitions that the plan deals rows out to by a given number."""
    return [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1])]


def test_pages_are_added_up_in_tasks_of_bounded_size(spark, data, monkeypatch):
    monkeypatch.setattr(records, "ROWS", 500)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    found = QUERIES["complete_pages"](spark, data)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert dealt_to(found)[0] == 1 + rows // 500 > 10
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    out = con.sql(ORACLE_SQL["complete_pages"])
    assert sorted(tuple(r[c] for c in out.columns) for r in found.collect()) == sorted(out.fetchall())


def test_pages_of_one_job_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(records, "ROWS", 100)
    rows = [("hot", k % 700, 700) for k in range(1500)] + [("gap", 1, 2), ("gap", None, 2), ("gap", 1, None), (None, 5, 1), ("void", None, None)]
    frame = spark.createDataFrame(rows, "pages string, page int, total int")
    got = records.complete_pages(frame, ["pages"], "page", "total").toDF("job", "pages", "expected", "complete")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("hot", 700, 700, True), ("gap", 1, 2, False), (None, 1, 1, True), ("void", 0, None, None)], key=repr)
    counted = records.complete_pages(frame, ["pages"], "page").toDF("job", "pages", "expected", "complete")
    assert sorted(map(tuple, counted.collect()), key=repr) == sorted([("hot", 700, 1500, False), ("gap", 1, 3, False), (None, 1, 1, True), ("void", 0, 1, False)], key=repr)
    assert set(dealt_to(counted)) == {16}


@pytest.mark.parametrize("name", ["signal_decode", "signal_dictionary_check"])
def test_code_of_a_stage_is_compiled(name, spark, data):
    # a method of over 8,000 bytes is interpreted by the JVM, byte by byte, for every frame
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code, most = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan).iterator(), []
    while code.hasNext():
        most.append(code.next()._3().maxMethodCodeSize())
    assert 0 < max(most) < 8000
