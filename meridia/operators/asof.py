"""As-of and interval joins on event time.

Rows with a null key or time match nothing; empty tables give empty results; columns of the
operators' own give way to the tables'. A column that both sides have under one name keeps
the left side's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import unused
from meridia.functions.scratch import work_dir
from meridia.functions.time import DAY

from .history import MOST, with_time_bucket


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, carry: list[str], bucket: int, tolerance: int | None = None, most: int = MOST) -> DataFrame:
    """Each left row with the ``carry`` columns of the right row of its key that is latest at
    or before it (at equal times the right row counts; of several the one that is largest by
    ``carry``). ``time`` is an integer column on both sides. Adds matched_<time>; of carried
    columns that the left side has, the right row's come under the name <column>_right.

    A union and a running ``last``, in two levels: inside time buckets, and over the last
    right row of each bucket. Crowded buckets are cut by their number of rows, so a key with a
    large share of all rows is many windows.
    """
    b, side, right_, last_, before_, in_, hit = unused([*left.columns, *right.columns], "_b", "_side", "_right", "_last", "_before", "_in", "_hit")
    packed = F.struct(F.col(time).alias("_t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    kind = right.select(packed.alias("x")).schema["x"].dataType
    rows = left.withColumns({right_: F.lit(None).cast(kind), side: F.lit(1)})
    points = right.filter(F.col(time).isNotNull()).select(*on, F.col(time), packed.alias(right_), F.lit(0).alias(side))
    both = with_time_bucket(rows.unionByName(points, allowMissingColumns=True), on, time, bucket, most, b)
    lasts = both.groupBy(*on, b).agg(F.max(right_).alias(last_))
    over = Window.partitionBy(*on).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.withColumn(before_, F.last(last_, ignorenulls=True).over(over)).select(*on, b, before_)
    within = Window.partitionBy(*on, b).orderBy(time, side, F.col(right_).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(in_, F.last(right_, ignorenulls=True).over(within)).filter(F.col(side) == 1)
    found = found.join(before, [*on, b], "left").withColumn(hit, F.when(F.col(time).isNotNull(), F.coalesce(in_, before_)))
    if tolerance is not None:
        found = found.withColumn(hit, F.when(F.col(time) - F.col(hit)["_t"] <= tolerance, F.col(hit)))
    out = [F.col(hit)[f"c{k}"].alias(f"{c}_right" if c in left.columns else c) for k, c in enumerate(carry)]
    return found.select(*left.columns, F.col(hit)["_t"].alias(f"matched_{time}"), *out)


def interval_join(anchors: DataFrame, points: DataFrame, on: list[str], anchor_time: str, point_time: str, width: int) -> DataFrame:
    """Pairs of one key whose times differ by at most ``width``: an equi-join on buckets of
    that width, each point sent to its own and both neighbouring buckets. It returns every
    pair; where a few nearest points are wanted, ``nearest_points`` makes no others."""
    [b] = unused([*anchors.columns, *points.columns], "_b")
    a = anchors.withColumn(b, F.floor(F.col(anchor_time) / width))
    near: Column = F.abs(F.col(anchor_time) - F.col(point_time)) <= width
    sent = points.withColumn(b, F.explode(F.array(*(F.floor(F.col(point_time) / width) + k for k in (-1, 0, 1)))))
    return a.join(sent, [*on, b]).filter(near).drop(b)


def nearest_points(anchors: DataFrame, points: DataFrame, on: list[str], anchor_time: str, point_time: str, point_id: str, k: int, width: int, bucket: int = DAY, most: int = MOST) -> DataFrame:
    """Pairs of each anchor with the ``k`` points before it and the ``k`` at or after it that are
    nearest in time, within ``width``; ties to the smaller ``point_id`` (a number).

    Points are numbered along the key's time, once in each direction of ties; an anchor knows
    how many points are before it, so its pairs are an equi-join on (key, direction, number).
    However dense a key is, an anchor makes 2k pairs at most and no key is one task. Both tables
    are bucketed together and written once, as narrow as they were given."""
    spark = anchors.sparkSession
    b, at, side, seq, a, p, up, ties, upto, sum_, base, way = unused([*anchors.columns, *points.columns], "_b", "_at", "_side", "_seq", "_a", "_p", "_up", "_ties", "_upto", "_sum", "_base", "_way")
    given = lambda rows, time: rows.dropna(subset=[*on, time])
    wanted = given(anchors, anchor_time).select(*on, F.col(anchor_time).alias(at), F.lit(0).alias(side), F.struct(*anchors.columns).alias(a))
    marks = given(points, point_time).select(*on, F.col(point_time).alias(at), F.lit(1).alias(side), F.col(point_id).alias(seq), F.struct(*points.columns).alias(p))
    held = with_time_bucket(wanted.unionByName(marks, allowMissingColumns=True), on, at, bucket, most, b)
    place = f"{work_dir(spark)}/nearest"
    held.write.parquet(place)
    held = spark.read.schema(held.schema).parquet(place)
    # anchors sort before points of their time, so the count up to them is of what is before
    cell = Window.partitionBy(*on, b)
    counted = held.withColumn(up, F.sum(side).over(cell.orderBy(at, side, seq).rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn(upto, F.sum(side).over(cell.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = counted.withColumn(ties, F.sum(side).over(Window.partitionBy(*on, b, at)))
    earlier = Window.partitionBy(*on).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy(*on, b).agg(F.sum(side).alias(sum_)).select(*on, b, F.coalesce(F.sum(sum_).over(earlier), F.lit(0)).alias(base))
    numbered = counted.join(bases, [*on, b], "left")
    seen = F.col(base) + F.col(up)
    step = lambda d, n: F.struct(F.lit(d).alias("d"), n.alias("n"))
    later = F.transform(F.sequence(seen + 1, seen + k), lambda n: step(0, n))
    before = F.transform(F.sequence(seen - k + 1, seen), lambda n: step(1, n))
    down = F.col(base) + 2 * F.col(upto) - F.col(ties) - F.col(up) + 1  # the number where ties run the other way
    left = numbered.filter(F.col(side) == 0).select(*on, a, F.explode(F.concat(later, before)).alias(way))
    right = numbered.filter(F.col(side) == 1).select(*on, p, F.explode(F.array(step(0, seen), step(1, down))).alias(way))
    pairs = left.join(right, [*on, way]).filter(F.abs(F.col(a)[anchor_time] - F.col(p)[point_time]) <= width)
    others = [c for c in points.columns if c not in on and c not in anchors.columns]
    return pairs.select(*(F.col(a)[c].alias(c) for c in anchors.columns), *(F.col(p)[c].alias(c) for c in others))
