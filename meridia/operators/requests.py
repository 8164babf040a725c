"""Free texts that ask for a report, read as vehicle and time range.

Spans of the text are found by pattern: vehicle ids (seventeen signs), dates, relative days, times of
day and zones. Each span has one or more meanings, and the spans together one or more readings. A
text with exactly one reading is ``ready``; with none or several it is a question, never a guess:
``no_vehicle``, ``several_vehicles``, ``needs_date``, ``needs_time``, ``impossible`` (no reading is
a time) or ``ambiguous``. The raw text and the time of receipt stay beside what was read, with the
basis of each part, so a reading can be checked later.

* Dates: ``2026-11-03`` (also with ``/`` or ``.``), ``2026年11月3日``; without a year ``11月3日``, which is its
  latest day at or before the receipt; ``3/11``, which is the 3rd of November or the 11th of March, in the
  latest year likewise, where both are days, and else the one that is.
* Relative days: today, yesterday, 今天, 昨天, 前天, in the zone of the text, by the time of receipt.
* Times: ``9:53``, ``09:53:10``, each with am or pm or behind 上午, 下午 or 晚上; ``9点``, ``9点半``, ``9点53分``.
* Zones: UTC or GMT, with or without hours (``UTC+8``, ``+08:00``), ``Z`` behind a time, 北京时间; else the default.

Two times are a range; one that ends at or before its start ends on the next day, unless a second
date says when. Everything is column expressions over one row. Null and empty texts are
``no_vehicle``; relative days without a time of receipt are ``impossible``; repeated spans of one
meaning count once; extra columns go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.names import quoted, unused
from meridia.functions.time import DAY

# The patterns of the spans.
VEHICLE = r"(?<![A-Za-z0-9_])((?=[0-9]*[A-HJ-NPR-Z])[A-HJ-NPR-Z0-9]{17})(?![A-Za-z0-9_])"
DATE = r"((?<![0-9])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|(?<![0-9年])[0-9]{1,2}月[0-9]{1,2}日|(?<![0-9/.-])[0-9]{1,2}/[0-9]{1,2}(?![0-9/])|(?i:(?<![a-z])today(?![a-z])|(?<![a-z])yesterday(?![a-z]))|今天|昨天|前天)"
TIME = r"((?:上午|下午|晚上)?\s*(?:(?<![0-9:+-])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?![0-9:])|(?<![0-9])[0-9]{1,2}点(?:半|[0-9]{1,2}分)?)(?:\s*(?i:am|pm)(?![a-z]))?)"
ZONE = r"((?i:(?<![a-z])(?:UTC|GMT)(?:\s*[+-][0-9]{1,2}(?::?[0-9]{2})?)?(?![a-z0-9]))|(?<=[0-9 ])[+-][0-9]{2}:[0-9]{2}(?![0-9:])|(?<=[0-9])Z(?![A-Za-z0-9])|北京时间)"


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("y-M-d")).cast("date")


def _latest(month: Column, day: Column, today: Column) -> Column:
    """The latest such day at or before today (up to a leap year's turn)."""
    years = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: _day((F.year(today) - k).cast("string"), month, day))
    return F.try_element_at(F.filter(years, lambda d: d <= today), F.lit(1))


def _dates(span: Column, today: Column) -> Column:
    """Meanings of a date span: an array of (day, basis)."""
    n = F.regexp_extract_all(span, F.lit("([0-9]+)"), F.lit(1))
    part = lambda k: F.try_element_at(n, F.lit(k))
    meaning = lambda day, basis: F.struct(day.alias("day"), F.lit(basis).alias("basis"))
    back = F.when(F.lower(span).isin("today", "今天"), 0).when(F.lower(span).isin("yesterday", "昨天"), 1).otherwise(2)
    either = F.array(meaning(_latest(part(2), part(1), today), "day and month"), meaning(_latest(part(1), part(2), today), "month and day"))
    found = F.when(F.size(n) == 3, F.array(meaning(_day(part(1), part(2), part(3)), "written date"))).when(F.size(n) == 0, F.array(meaning(F.date_sub(today, back), "relative day")))
    found = found.when(span.contains("月"), F.array(meaning(_latest(part(1), part(2), today), "month and day"))).otherwise(either)
    return F.filter(found, lambda m: m["day"].isNotNull())


def _seconds(span: Column) -> Column:
    """Seconds of the day that a time span says; null if there is no such time."""
    n = F.transform(F.regexp_extract_all(span, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    part = lambda k: F.coalesce(F.try_element_at(n, F.lit(k)), F.lit(0))
    late, early = span.rlike("(?i)pm|下午|晚上"), span.rlike("(?i)am|上午")
    hour = F.when(late & (part(1) < 12), part(1) + 12).when(early & (part(1) == 12), 0).otherwise(part(1))
    minute = F.when(span.contains("半"), 30).otherwise(part(2))
    fine = (hour < 24) & (minute < 60) & (part(3) < 60) & ~(early & (part(1) > 12))
    return F.when(fine, hour * 3600 + minute * 60 + part(3)).cast("long")


def _offset(span: Column) -> Column:
    """Microseconds that a zone span lies before UTC."""
    n = F.regexp_extract_all(span, F.lit("([0-9]+)"), F.lit(1))
    digits = F.coalesce(F.try_element_at(n, F.lit(1)), F.lit("0"))
    joined = F.length(digits) > 2
    hours = F.when(joined, F.substring(digits, 1, 2)).otherwise(digits).cast("long")
    minutes = F.when(joined, F.substring(digits, 3, 2)).otherwise(F.coalesce(F.try_element_at(n, F.lit(2)), F.lit("0"))).cast("long")
    size = hours * 3_600_000_000 + minutes * 60_000_000
    return F.when(span == "北京时间", 8 * 3_600_000_000).when(span.contains("-"), -size).otherwise(size)


def read_requests(rows: DataFrame, text: str = "raw_text", received: str = "received_us", zone: str = "Asia/Shanghai") -> DataFrame:
    """Rows with vehicle, start_us, end_us, readings, status and basis. ``received`` is in microseconds."""
    new = ("vehicle", "start_us", "end_us", "readings", "status", "basis")
    kept = [c for c in rows.columns if c.lower() not in new]
    names = unused(rows.columns, "_vehicles", "_zones", "_today", "_dates", "_times", "_found", "_spans", "_sound")
    vehicles, zones, today, dates, times, found, spans, sound = names
    raw = F.coalesce(F.col(quoted(text)), F.lit(""))
    out = rows.withColumns({vehicles: _all(raw, VEHICLE), zones: F.array_distinct(F.transform(_all(raw, ZONE), _offset)), spans: _all(raw, DATE)})
    # a day begins in the zone of the text; civil times of the default zone follow its rules
    written = F.when(F.size(zones) == 1, F.element_at(zones, 1))
    at = F.timestamp_micros(F.col(quoted(received)))
    out = out.withColumn(today, F.when(written.isNotNull(), F.timestamp_micros(F.col(quoted(received)) + written)).otherwise(F.from_utc_timestamp(at, zone)).cast("date"))
    out = out.withColumns({dates: F.transform(F.col(spans), lambda s: _dates(s, F.col(today))), times: F.transform(F.regexp_extract_all(raw, F.lit(TIME), F.lit(1)), _seconds)})

    def instant(day: Column, second: Column) -> Column:
        civil = F.unix_micros(day.cast("timestamp")) + second * 1_000_000
        return F.when(written.isNotNull(), civil - written).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(civil), zone)))

    second = lambda k: F.try_element_at(F.col(times), F.lit(k))
    turn = F.when(second(2) <= second(1), F.lit(DAY)).otherwise(F.lit(0))
    reading = lambda a, z, basis: F.struct(a.alias("a"), z.alias("z"), basis.alias("basis"))
    first, last = F.try_element_at(F.col(dates), F.lit(1)), F.try_element_at(F.col(dates), F.lit(2))
    one = F.transform(first, lambda d: reading(instant(d["day"], second(1)), instant(d["day"], second(2)) + turn, d["basis"]))
    two = F.flatten(F.transform(first, lambda d: F.transform(last, lambda e: reading(instant(d["day"], second(1)), instant(e["day"], second(2)), F.concat_ws(" to ", d["basis"], e["basis"])))))
    whole = F.when(F.size(dates) == 1, one).when(F.size(dates) == 2, two)
    out = out.withColumn(sound, F.filter(whole, lambda r: r["a"].isNotNull() & (r["z"] > r["a"])))
    # readings that mean the same range are one
    out = out.withColumn(found, F.filter(F.col(sound), lambda r, k: F.size(F.filter(F.slice(F.col(sound), F.lit(1), k), lambda q: (q["a"] == r["a"]) & (q["z"] == r["z"]))) == 0))
    n = F.coalesce(F.size(found), F.lit(0))
    status = (
        F.when(F.size(vehicles) == 0, "no_vehicle").when(F.size(vehicles) > 1, "several_vehicles").when(F.size(spans) == 0, "needs_date").when(F.size(times) < 2, "needs_time")
        .when((F.size(times) > 2) | (F.size(spans) > 2) | (F.size(zones) > 1), "ambiguous").when(n == 0, "impossible").when(n > 1, "ambiguous").otherwise("ready")
    )
    ready = status == "ready"
    best = F.try_element_at(F.col(found), F.lit(1))
    basis = F.concat_ws("; ", best["basis"], F.when(F.size(zones) == 1, "zone written").otherwise(F.lit(f"zone {zone}")), F.when((F.size(dates) == 1) & (turn > 0), "ends next day"))
    return out.select(
        *(F.col(quoted(c)) for c in kept), F.when(F.size(vehicles) == 1, F.element_at(vehicles, 1)).alias("vehicle"), F.when(ready, best["a"]).alias("start_us"),
        F.when(ready, best["z"]).alias("end_us"), n.cast("int").alias("readings"), status.alias("status"), F.when(ready, basis).alias("basis"),
    )
