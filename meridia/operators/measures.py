"""Intervals, rates, gaps, runs, sessions, quantiles and histograms of event series.

A null key is a key; rows without a value are left out of quantiles, rows without a time come
first in histories; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import unused
from meridia.functions.time import DAY

from .history import with_island, with_row_before


def with_gap(rows: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """Adds gap_us, the time since the key's row before (null for its first)."""
    [before] = unused(rows.columns, "_before_us")
    found = with_row_before(rows, by, time, tie, time, before)
    return found.withColumn("gap_us", F.col(time) - F.col(before)).drop(before)


def skips(rows: DataFrame, by: list[str], time: str, tie: str, over: int) -> DataFrame:
    return with_gap(rows, by, time, tie).filter(F.col("gap_us") > over)


def rate(rows: DataFrame, by: list[str], time: str, width: int) -> DataFrame:
    """Events of each time bucket, and per second."""
    bucket = (F.floor(F.col(time) / width) * width).alias("bucket_us")
    return rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n")).withColumn("per_second", F.col("n") / (width / 1e6))


def runs(rows: DataFrame, by: list[str], time: str, tie: str, state: str) -> DataFrame:
    """Islands of rows with one state: start, end and length. A null state equals no other."""
    numbered = with_island(rows.select(*dict.fromkeys([*by, time, tie, state])), by, time, tie, state, "island")
    return numbered.groupBy(*by, "island", state).agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """Sessions that end after ``gap`` without an event (a gap of exactly that joins)."""
    from meridia.functions.time import to_us

    found = rows.groupBy(*by, F.session_window(F.col(ts), gap).alias("_w")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"), F.count(F.lit(1)).alias("n"))
    return found.select(*by, to_us(F.col("_a")).alias("start_us"), to_us(F.col("_z")).alias("end_us"), "n")


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of numbers, whatever the size of a group.

    Spark's approximate percentiles, whose ranks are off by at most 1/accuracy of a group,
    bracket each quantile. All rows are counted below the brackets; only values inside them
    (some 4/accuracy of the rows) are ranked, by counts of distinct ones. Everything but
    that ranking combines on the map side."""
    own = [f"by{k}" for k in range(len(by))]
    given = rows.select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), F.col(value).alias("value"))
    found = _quantiles(given, own, "value", {f"q{k}": q for k, q in enumerate(wanted.values())}, accuracy)
    names = [F.col(o).alias(c) for c, o in zip(by, own, strict=True)]
    return found.select(*names, "n", *(F.col(f"q{k}").alias(name) for k, name in enumerate(wanted)))


def _quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], accuracy: int) -> DataFrame:
    given = rows.filter(F.col(value).isNotNull())
    brackets = []
    for k, q in enumerate(wanted.values()):
        low, high = max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)
        brackets += [F.percentile_approx(value, F.lit(low), F.lit(accuracy)).alias(f"_lo{k}"), F.percentile_approx(value, F.lit(high), F.lit(accuracy)).alias(f"_hi{k}")]
    keys = unused(rows.columns, *(f"_by{k}" for k in range(len(by))))
    stats = given.groupBy(*(F.col(c).alias(h) for c, h in zip(by, keys, strict=True))).agg(*brackets)
    same = F.lit(True)
    for c, h in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    at = given.join(stats, same)
    v, below, beyond = F.col(value), [], []  # a rank may be one place outside its bracket: the values next to it
    for k in range(len(wanted)):
        below.append(F.sum((v < F.col(f"_lo{k}")).cast("long")).alias(f"_below{k}"))
        beyond += [F.max(F.when(v < F.col(f"_lo{k}"), v)).alias(f"_last{k}"), F.min(F.when(v > F.col(f"_hi{k}"), v)).alias(f"_next{k}")]
    whole = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *below, *beyond)
    inside = F.filter(F.array(*(F.when((v >= F.col(f"_lo{k}")) & (v <= F.col(f"_hi{k}")), F.lit(k)) for k in range(len(wanted)))), lambda x: x.isNotNull())
    counts = at.select(*by, F.explode(inside).alias("_q"), v.alias("_v")).groupBy(*by, "_q", "_v").agg(F.count(F.lit(1)).alias("_m"))
    # number of values up to this one, from the bracket's lower end
    seen = counts.withColumn("_seen", F.sum("_m").over(Window.partitionBy(*by, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = seen.select(*(F.col(c).alias(h) for c, h in zip(by, keys, strict=True)), "_q", "_v", "_seen").join(whole, same)
    picks = []
    for k, q in enumerate(wanted.values()):
        place = F.lit(q) * (F.col("n") - 1)
        for end, f in (("lo", F.floor), ("hi", F.ceil)):
            hit = (F.col("_q") == k) & (F.col(f"_below{k}") + F.col("_seen") > f(place))
            inner = F.coalesce(F.min(F.when(hit, F.col("_v"))), F.first(f"_next{k}"))
            picks.append(F.when(F.first(F.col(f"_below{k}") > f(place)), F.first(f"_last{k}")).otherwise(inner).alias(f"_{end}_{k}"))
    out = ranked.groupBy(*by, "n").agg(*picks)
    for k, (name, q) in enumerate(wanted.items()):
        place = F.lit(q) * (F.col("n") - 1)
        between = (F.ceil(place) - place) * F.col(f"_lo_{k}") + (place - F.floor(place)) * F.col(f"_hi_{k}")
        out = out.withColumn(name, F.when(F.ceil(place) == F.floor(place), F.col(f"_lo_{k}")).otherwise(between))
    return out.select(*by, "n", *wanted)


def histogram(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    return rows.groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stage_durations(rows: DataFrame, by: list[str], stage: str, time: str, limit: int) -> DataFrame:
    """Duration of each key's stage, summed up per stage with the number over ``limit``."""
    [d] = unused(rows.columns, "_d")
    each = rows.groupBy(*by, stage).agg((F.max(time) - F.min(time)).alias(d))
    over = F.sum((F.col(d) > limit).cast("long")).alias("over_limit")
    return each.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min_us"), F.max(d).alias("max_us"), F.sum(d).alias("total_us"), over)


#: Bins of each power of two in a sketch, as a power of two: a value is told to 1 part in 128.
BITS = 7


def sketch_bin(value: Column) -> Column:
    """Bin of a whole number: itself below 256, above by its eight highest bits. Bins sort as values do."""
    size = F.abs(value)
    shift = F.greatest(F.length(F.bin(size)) - (BITS + 1), F.lit(0))
    up = F.call_function("shiftleft", shift.cast("long"), F.lit(BITS)) + F.call_function("shiftright", size, shift)
    return F.when(value < 0, -1 - up).otherwise(up)


def bin_value(bin_: Column) -> Column:
    """The number of a bin that is nearest to 0."""
    up = F.when(bin_ < 0, -1 - bin_).otherwise(bin_)
    shift = F.greatest(F.call_function("shiftright", up, F.lit(BITS)) - 1, F.lit(0)).cast("int")
    size = F.call_function("shiftleft", up - F.call_function("shiftleft", shift.cast("long"), F.lit(BITS)), shift)
    return F.when(bin_ < 0, -size).otherwise(size)


def day_sketches(rows: DataFrame, by: list[str], time: str, value: str, width: int = DAY) -> DataFrame:
    """(by, span, bin, n): a sketch of whole numbers for each key and span of time, as the number of
    values in each bin. Sketches are mergeable: that of several spans, or of rows that come later,
    is the sum by bin. One has some 7,000 rows at most, however many values it holds."""
    span, bin_ = F.floor(F.col(time) / width).alias("span"), sketch_bin(F.col(value).cast("long")).alias("bin")
    return rows.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(*by, span, bin_).agg(F.count(F.lit(1)).alias("n"))


def rolling_quantiles(sketches: DataFrame, by: list[str], spans: int, wanted: dict[str, float]) -> DataFrame:
    """(by, span, n, one column for each quantile): over each span that has values and the ``spans`` - 1
    before it. A quantile is that of place floor(q (n - 1)), told by its bin: off by less than 1 part
    in 128, towards 0. Sketches alone are read and shuffled, never the rows again."""
    own = [f"by{k}" for k in range(len(by))]
    rows = sketches.select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), "span", "bin", "n")
    days = rows.select(*(F.col(o).alias(f"_{o}") for o in own), F.col("span").alias("_span")).distinct()
    sent = rows.withColumn("span", F.explode(F.sequence(F.col("span"), F.col("span") + (spans - 1))))
    merged = sent.groupBy(*own, "span", "bin").agg(F.sum("n").alias("n"))
    same = F.col("span") == F.col("_span")
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"_{o}"))
    merged = merged.join(days, same, "left_semi")
    cell = Window.partitionBy(*own, "span")  # the bins of one sketch
    seen = merged.withColumns({"_upto": F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(cell)})
    found = [F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_all") - 1)), F.col("bin"))).alias(name) for name, q in wanted.items()]
    out = seen.groupBy(*own, "span").agg(F.sum("n").alias("n"), *found)
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, by, strict=True)), "span", "n", *(bin_value(F.col(name)).alias(name) for name in wanted))
