"""Row before and running sums of a key's history, in two levels: inside time buckets, and
over one row for each bucket. A key with a large share of all rows is thus many windows.

Null keys are a key; rows without a time are a bucket of their own before all others; empty
tables give empty results; extra columns are carried along. Columns of the operators' own
begin with an underscore and give way to the table's.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import unused
from meridia.functions.time import DAY

#: Rows of one key that one window takes, about.
MOST = 100_000


def with_time_bucket(rows: DataFrame, by: list[str], time: str, width: int, most: int, name: str) -> DataFrame:
    """Adds ``name``, the row's time bucket: a pair (bucket of ``width``, part) that sorts as time
    does. A key's bucket with over ``most`` rows is cut into parts of equal width, so many that
    each holds about that number where rows are spread over the bucket. Counts are combined
    on the map side, and only those of crowded buckets are joined back."""
    coarse, parts, *held = unused(rows.columns, "_coarse", "_parts", *(f"_by{k}" for k in range(len(by) + 1)))
    cut = rows.withColumn(coarse, F.floor(F.col(time) / width))
    counts = cut.groupBy(*by, coarse).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(most))).alias(parts)).filter(F.col(parts) > 1)
    crowded = counts.select(*(F.col(c).alias(h) for c, h in zip([*by, coarse], held, strict=True)), parts)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(h)) for c, h in zip([*by, coarse], held, strict=True)))
    part = F.floor((F.col(time) - F.col(coarse) * width) * F.coalesce(F.col(parts), F.lit(1)) / F.lit(width))
    found = cut.join(crowded, same, "left").withColumn(name, F.struct(F.col(coarse).alias("at"), part.alias("part")))
    return found.select(*rows.columns, name)


def _carry(rows: DataFrame, by: list[str], buckets: DataFrame, name: str) -> DataFrame:
    """Rows with ``name`` of their bucket; keys and buckets may be null."""
    held = unused([*rows.columns, *buckets.columns], *(f"_k{k}" for k in range(len(by))))
    right = buckets.select(*(F.col(c).alias(h) for c, h in zip(by, held, strict=True)), name)
    return rows.join(right, reduce(and_, (F.col(c).eqNullSafe(F.col(h)) for c, h in zip(by, held, strict=True))), "left").drop(*held)


def with_row_before(rows: DataFrame, by: list[str], time: str, tie: str, column: str, name: str, bucket: int = DAY, most: int = MOST) -> DataFrame:
    """Adds ``column`` of the key's row before, by time and tie (null for its first)."""
    b, p, last_, before_, in_ = unused([*rows.columns, name], "_b", "_p", "_last", "_before", "_in")
    held = with_time_bucket(rows, by, time, bucket, most, b).withColumn(p, F.struct(F.col(column).alias("v")))
    last = held.groupBy(*by, b).agg(F.max_by(p, F.struct(time, tie)).alias(last_))
    before = last.withColumn(before_, F.lag(last_).over(Window.partitionBy(*by).orderBy(b)))
    inside = held.withColumn(in_, F.lag(p).over(Window.partitionBy(*by, b).orderBy(time, tie)))
    found = _carry(inside, [*by, b], before, before_)
    return found.select(*rows.columns, F.coalesce(in_, before_)["v"].alias(name))


def with_running_sum(rows: DataFrame, by: list[str], time: str, tie: str, value: Column, name: str, bucket: int = DAY, most: int = MOST) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows up to this one, by time and tie."""
    b, v, sum_, before_, in_ = unused([*rows.columns, name], "_b", "_v", "_sum", "_before", "_in")
    held = with_time_bucket(rows.withColumn(v, value.cast("long")), by, time, bucket, most, b)
    total = held.groupBy(*by, b).agg(F.sum(v).alias(sum_))
    earlier = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = total.withColumn(before_, F.coalesce(F.sum(sum_).over(earlier), F.lit(0)))
    upto = Window.partitionBy(*by, b).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    found = _carry(held.withColumn(in_, F.sum(v).over(upto)), [*by, b], before, before_)
    return found.select(*rows.columns, (F.col(in_) + F.col(before_)).alias(name))


def with_island(rows: DataFrame, by: list[str], time: str, tie: str, state: str, name: str, bucket: int = DAY, most: int = MOST) -> DataFrame:
    """Adds the number of the row's island, from 1: rows of a key that follow each other by time and
    tie (and state, where both are equal) with one state; a null state equals no other. Changes
    are counted inside buckets; whether a bucket's first row begins an island is told by one row
    for each bucket, so rows are bucketed once."""
    b, p, new, in_, changes, first_, last_, base = unused([*rows.columns, name], "_b", "_p", "_new", "_in", "_changes", "_first", "_last", "_base")
    held = with_time_bucket(rows, by, time, bucket, most, b)
    within, order = Window.partitionBy(*by, b).orderBy(time, tie, state), F.struct(time, tie, state)
    same = F.coalesce(F.col(state) == F.col(p)["v"], F.lit(False))
    marked = held.withColumn(p, F.lag(F.struct(F.col(state).alias("v"))).over(within)).withColumn(new, F.when(F.col(p).isNull() | same, 0).otherwise(1))
    ends = [F.sum(new).alias(changes), F.min_by(state, order).alias(first_), F.max_by(state, order).alias(last_)]
    over = Window.partitionBy(*by).orderBy(b)
    begins = F.when(F.col(first_) == F.lag(last_).over(over), 0).otherwise(1)
    earlier = F.coalesce(F.sum(changes).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = marked.groupBy(*by, b).agg(*ends).withColumn(new, begins).withColumn(base, F.sum(new).over(over.rowsBetween(Window.unboundedPreceding, 0)) + earlier)
    inside = marked.withColumn(in_, F.sum(new).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _carry(inside, [*by, b], bases, base).select(*rows.columns, (F.col(in_) + F.col(base)).alias(name))
