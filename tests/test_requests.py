"""Request texts by hand."""

from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meridia.operators.requests import read_requests

V, W = "DEM0VEH1CLEX00001", "DEM0VEH1CLEX00002"
RECEIVED = datetime(2026, 11, 5, 17, 30, tzinfo=UTC)  # the 6th, 01:30, in Shanghai


def us(t):
    return int(t.timestamp()) * 1_000_000


def at(month, day, hour, minute, year=2026, zone=8, second=0):
    return us(datetime(year, month, day, hour, minute, second, tzinfo=timezone(timedelta(hours=zone))))


CASES = [
    (f"日志分析 {V}，2026-11-03 09:53 至 10:10", "ready", at(11, 3, 9, 53), at(11, 3, 10, 10), "written date; zone Asia/Shanghai"),
    (f"{V} 2026/11/3 9:53 - 10:10 UTC", "ready", at(11, 3, 9, 53, zone=0), at(11, 3, 10, 10, zone=0), "written date; zone written"),
    (f"{V} 2026.11.03 23:50 to 0:10", "ready", at(11, 3, 23, 50), at(11, 4, 0, 10), "written date; zone Asia/Shanghai; ends next day"),
    (f"{V} 2026年11月3日 下午3点 到 下午4点半", "ready", at(11, 3, 15, 0), at(11, 3, 16, 30), "written date; zone Asia/Shanghai"),
    (f"{V} 11月3日 上午9点5分 到 12:00:30", "ready", at(11, 3, 9, 5), at(11, 3, 12, 0, second=30), "month and day; zone Asia/Shanghai"),
    (f"{V} 12月24日 9:00 10:00", "ready", at(12, 24, 9, 0, 2025), at(12, 24, 10, 0, 2025), "month and day; zone Asia/Shanghai"),
    (f"{V} 2月29日 9:00 10:00", "ready", at(2, 29, 9, 0, 2024), at(2, 29, 10, 0, 2024), "month and day; zone Asia/Shanghai"),
    (f"report {V} yesterday 9:00 pm to 10:15 PM please", "ready", at(11, 5, 21, 0), at(11, 5, 22, 15), "relative day; zone Asia/Shanghai"),
    (f"{V} yesterday 9:00 to 10:00 UTC", "ready", at(11, 4, 9, 0, zone=0), at(11, 4, 10, 0, zone=0), "relative day; zone written"),
    (f"{V} 前天 12:00 am 到 12:30 am", "ready", at(11, 4, 0, 0), at(11, 4, 0, 30), "relative day; zone Asia/Shanghai"),
    (f"{V} 2026-11-03 22:00 to 2026-11-04 06:00", "ready", at(11, 3, 22, 0), at(11, 4, 6, 0), "written date to written date; zone Asia/Shanghai"),
    (f"{V} 2026-11-03 09:00+02:00 to 10:00", "ready", at(11, 3, 9, 0, zone=2), at(11, 3, 10, 0, zone=2), "written date; zone written"),
    (f"{V} 2026-11-03 09:00Z 10:00Z", "ready", at(11, 3, 9, 0, zone=0), at(11, 3, 10, 0, zone=0), "written date; zone written"),
    (f"{V} 2026-11-03 09:00 10:00 UTC-0330", "ready", at(11, 3, 12, 30, zone=0), at(11, 3, 13, 30, zone=0), "written date; zone written"),
    (f"{V} 北京时间 2026-11-03 09:00 10:00, again {V}", "ready", at(11, 3, 9, 0), at(11, 3, 10, 0), "written date; zone written"),
    (f"{V} 25/10 9:00 10:00", "ready", at(10, 25, 9, 0), at(10, 25, 10, 0), "day and month; zone Asia/Shanghai"),
    (f"{V} 4/4 9:00 10:00", "ready", at(4, 4, 9, 0), at(4, 4, 10, 0), "day and month; zone Asia/Shanghai"),
    (f"{V} 3/4 9:00 10:00", "ambiguous", None, None, None),
    (f"{V} 2026-11-03 9:00 10:00 11:00", "ambiguous", None, None, None),
    (f"{V} 2026-11-03 9:00 10:00 UTC or GMT+1", "ambiguous", None, None, None),
    (f"{V} 2026-11-01 2026-11-02 2026-11-03 9:00 10:00", "ambiguous", None, None, None),
    (f"{V} 2026-02-30 9:00 10:00", "impossible", None, None, None),
    (f"{V} 2026-11-03 9:00 25:00", "impossible", None, None, None),
    (f"{V} 2026-11-04 9:00 2026-11-03 10:00", "impossible", None, None, None),
    (f"{V} 9:00 10:00", "needs_date", None, None, None),
    (f"{V} 2026-11-03 9:00", "needs_time", None, None, None),
    (f"{V} {W} 2026-11-03 9:00 10:00", "several_vehicles", None, None, None),
    ("12345678901234567 2026-11-03 9:00 10:00", "no_vehicle", None, None, None),
    (f"x{V} 2026-11-03 9:00 10:00", "no_vehicle", None, None, None),
    ("", "no_vehicle", None, None, None),
    (None, "no_vehicle", None, None, None),
]


def test_readings(spark):
    rows = spark.createDataFrame([(k, t, us(RECEIVED)) for k, (t, *_) in enumerate(CASES)], "k int, raw_text string, received_us long").withColumns({"_dates": F.lit(1), "status": F.lit("theirs"), "_found": F.lit(2)})
    got = {r["k"]: r for r in read_requests(rows).collect()}
    for k, (text, status, a, z, basis) in enumerate(CASES):
        r = got[k]
        assert (r["status"], r["start_us"], r["end_us"], r["basis"], r["raw_text"], r["received_us"], r["_dates"]) == (status, a, z, basis, text, us(RECEIVED), 1), text
    assert got[17]["readings"] == 2 and got[0]["vehicle"] == V


def test_no_time_of_receipt(spark):
    rows = spark.createDataFrame([(f"{V} today 9:00 10:00", None), (f"{V} 2026-11-03 9:00 10:00", None)], "raw_text string, received_us long")
    assert [r["status"] for r in read_requests(rows).collect()] == ["impossible", "ready"]
    assert read_requests(rows.limit(0)).count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_civil_times_of_other_zones(spark, zone):
    from zoneinfo import ZoneInfo

    rows = spark.createDataFrame([(f"{V} 2026-{m:02d}-15 09:30 18:45", us(RECEIVED)) for m in range(1, 13)], "raw_text string, received_us long")
    got = sorted(r["start_us"] for r in read_requests(rows, zone=zone).collect())
    assert got == [us(datetime(2026, m, 15, 9, 30, tzinfo=ZoneInfo(zone))) for m in range(1, 13)]
