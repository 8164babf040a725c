"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by (source, exact size): a map-side combined aggregation.
2. Targets: sources in code point order (null last) weigh 1, 2, 3, repeating; a target stops
   at ``MAX_COPIES`` times its source's size and the excess is shared out again by weight.
   That fixed point has a closed form over sources sorted by cap per weight.
3. For each source a plan over its size counts: as many full passes as fit, then of each size
   the same fraction, then sizes from large to small while they fit, and bounded-knapsack
   dynamic programming for the last ``BUDGET`` words. A plan sees size counts, not documents.
   A plan that misses its target is repaired by a subset-sum over all sizes, long ones too:
   first among plans that take each document ``passes`` times or once more, then among all of
   at most ``MAX_COPIES``. More and more documents of each size are free to change, at most
   ``POOL`` words (over the sizes' common divisor); where that holds all of them the total is
   the nearest there is.
4. Of each (source, size) the planned number of documents is taken in the order of a seeded
   hash. That order is cut into ranges of about ``RANGE`` documents, so only the range in
   which the plan ends is ranked and no window holds a hot size whole.

Defined results: null or blank text has size 0 and is never taken; a null source is a source;
ids may be null or repeat, each row is a document; an empty table gives an empty result; extra
columns are carried along by ``mix_documents``, whatever their names. Reruns on the same rows agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted, unused

from .scratch import bound_batches, materialize

MAX_COPIES, SEED, BUDGET, RANGE, POOL = 3, 17, 8192, 10_000, 2**23


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(id_col: Column, text: Column, seed: int = SEED) -> Column:
    """A document's place in its size's order: a signed 64-bit hash."""
    return F.xxhash64(F.lit(seed), id_col, text)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(_ts, source_size, target) from rows of (source, size, n). One row for each source
    goes through one task here; documents don't."""
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = total.withColumn("_w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * MAX_COPIES)
    order = [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Words per unit of weight for this source and those after it, with all before it capped.
    # It grows while sources are rightly capped and falls after, so the largest is the rate.
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    share = ranked.withColumn("_rate", rest / weight)
    rate = F.max("_rate").over(Window.partitionBy(F.lit(0)))
    target = F.least(F.col("_cap").cast("double"), rate * F.col("_w"))
    return share.select(F.col("source").alias("_ts"), "source_size", target.alias("target"))


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, goal: int | None = None) -> tuple[np.ndarray, int]:
    """Bounded knapsack: how many of each size (at most ``counts``) sum to the reachable
    total within ``budget`` that is nearest to ``goal`` (by default the budget itself).
    Time and memory grow with sizes times budget."""
    goal = budget if goal is None else goal
    use = np.flatnonzero((sizes > 0) & (sizes <= budget) & (counts > 0))
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    via: list[tuple[int, np.ndarray]] = []
    for k in use:
        # after size k: least copies of it with which each total is reached
        least = np.where(reach, 0, np.iinfo(np.int64).max // 2)
        s = int(sizes[k])
        rows = -(-(budget + 1) // s)
        grid = np.full(rows * s, np.iinfo(np.int64).max // 2)
        grid[: budget + 1] = least
        grid = grid.reshape(rows, s)
        steps = np.arange(rows)[:, None]
        least = (np.minimum.accumulate(grid - steps, axis=0) + steps).reshape(-1)[: budget + 1]
        now = least <= counts[k]
        if (now & ~reach).any():
            via.append((int(k), np.where(now, least, 0).astype(np.int32)))
            reach = now | reach
        if reach[goal]:
            break
    totals = np.flatnonzero(reach)
    best = int(totals[np.argmin(np.abs(totals - goal))])
    take, left = np.zeros(len(sizes), np.int64), best
    for k, least in reversed(via):
        take[k] = least[left]
        left -= int(take[k]) * int(sizes[k])
    return take, best


def nearest_counts(sizes: np.ndarray, counts: np.ndarray, goal: int, cap: int) -> np.ndarray:
    """Bounded subset-sum: how many of each size (at most ``counts``) sum to the total within
    ``cap`` that is nearest to ``goal``. Counts are split in binary, reached totals are bits,
    and each total keeps the item that first reached it."""
    take = np.zeros(len(sizes), np.int64)
    use = [int(k) for k in np.argsort(sizes, kind="stable") if 0 < sizes[k] <= cap and counts[k] > 0]
    if not use or goal <= 0:
        return take
    unit = int(np.gcd.reduce(sizes[use]))
    top, aim = cap // unit, min((2 * goal + unit) // (2 * unit), cap // unit)
    first = np.full(top + 1, -1, np.int32)
    mask, reach, items = (1 << (top + 1)) - 1, 1, []
    for k in use:
        left, part, s = min(int(counts[k]), cap // int(sizes[k])), 1, int(sizes[k]) // unit
        while left and first[aim] < 0:
            part = min(part, left)
            new = ((reach << part * s) & mask) & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(raw)
                for lo in range(0, len(at), 65_536):
                    cell = at[lo : lo + 65_536]
                    row, bit = np.nonzero(np.unpackbits(raw[cell][:, None], axis=1, bitorder="little"))
                    first[cell[row] * 8 + bit] = len(items)
                reach |= new
            items.append((k, part))
            left, part = left - part, part * 2
    found = first >= 0
    found[0] = True
    base = min(goal // unit, top)
    best = base - int(np.argmax(found[base::-1]))
    over = found[base + 1 :]
    if over.any():
        above = base + 1 + int(np.argmax(over))
        best = above if above * unit - goal < goal - best * unit else best
    while best:
        k, part = items[first[best]]
        take[k] += part
        best -= part * int(sizes[k]) // unit
    return take


def repair(sizes: np.ndarray, plan: np.ndarray, low: np.ndarray, high: np.ndarray, want: int) -> np.ndarray:
    """The plan (copies of each size, between low and high) changed so that its words come
    nearer to ``want``, with as few documents of each size free to change as do."""
    unit = int(np.gcd.reduce(sizes))
    least = min(want % unit, -want % unit) if unit else 0
    order = np.argsort(sizes, kind="stable")
    gap, free = want - int((plan * sizes).sum()), 1
    while unit and abs(gap) > least:
        down, up = np.minimum(free, plan - low), np.minimum(free, high - plan)
        if gap + int((down * sizes).sum()) + abs(gap) > POOL * unit:  # short sizes first, as many as the pool holds
            words = np.empty(len(sizes), np.int64)
            words[order] = np.cumsum(((down + up) * sizes)[order])
            down, up = np.where(words <= POOL * unit, down, 0), np.where(words <= POOL * unit, up, 0)
        goal = gap + int((down * sizes).sum())
        cap = min(goal + abs(gap) - 1, int(((down + up) * sizes).sum()))
        changed = plan - down + nearest_counts(sizes, down + up, goal, cap)
        if abs(want - int((changed * sizes).sum())) < abs(gap):
            plan, gap = changed, want - int((changed * sizes).sum())
        if free >= int((high - low).max()):
            break
        free *= 8
    return plan


def fit_budget(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(full passes, further copies of each size) whose words come nearest to target. Copies
    are at most the documents of a size, or else passes is 0 and they hold all."""
    whole, want = int((sizes * counts).sum()), round(target)
    passes, take = _first_plan(sizes, counts, whole, want)
    if passes == MAX_COPIES or want <= 0 or not whole:
        return passes, take
    counts = np.where(sizes > 0, counts, 0)
    plan = repair(sizes, passes * counts + take, passes * counts, (passes + 1) * counts, want)
    wide = repair(sizes, plan, 0 * counts, MAX_COPIES * counts, want)
    return (passes, plan - passes * counts) if (wide == plan).all() else (0, wide)


def _first_plan(sizes: np.ndarray, counts: np.ndarray, whole: int, want: int) -> tuple[int, np.ndarray]:
    """(full passes, further documents of each size): in proportion, then large to small, then
    a knapsack for the last words."""
    if not whole or want <= 0:
        return 0, np.zeros(len(sizes), np.int64)
    passes = min(want // whole, MAX_COPIES)
    left = want - passes * whole
    if passes == MAX_COPIES or not left:
        return passes, np.zeros(len(sizes), np.int64)
    take = np.array([int(c) * left // whole if s else 0 for s, c in zip(sizes, counts, strict=True)], np.int64)
    left -= int((take * sizes).sum())
    for k in np.argsort(-sizes, kind="stable"):
        if left <= BUDGET or not sizes[k]:
            break
        more = min(int(counts[k] - take[k]), (left - BUDGET // 2) // int(sizes[k]))
        if more > 0:
            take[k] += more
            left -= more * int(sizes[k])
    if left <= BUDGET:
        extra, got = subset_counts(sizes, counts - take, left)
        if got < left:  # a total beyond the target may be nearer to it
            extra, got = subset_counts(sizes, counts - take, 2 * left - got - 1, left)
        return passes, take + extra
    over = np.flatnonzero((take < counts) & (sizes > 0))
    if len(over):  # only large documents are left: one more may be nearer than none
        k = over[np.argmin(np.abs(sizes[over] - left))]
        take[k] += abs(left - int(sizes[k])) < left
    return passes, take


def plan_mix(sizes: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, _base, _take) from rows of (source, size, n)."""
    bound_batches(sizes.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
        n = rows["n"].to_numpy(np.int64)
        base, take = fit_budget(rows["size"].to_numpy(np.int64), n, float(rows["target"].iloc[0]))
        base, take = np.divmod(base * n + take, n)
        return rows.drop(columns="_key").assign(_base=base, _take=take)

    kind = sizes.schema["source"].dataType.simpleString()
    targets = source_targets(sizes)
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("_ts")))
    keyed = joined.select("source", "size", "n", "source_size", "target", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_key"))
    return keyed.groupBy("_key").applyInPandas(run, f"source {kind}, size long, n long, source_size long, target double, _base long, _take long")


def _range(h: Column, n: Column) -> Column:
    """Number of the range of the seeded order in which a hash falls."""
    return F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(n / F.lit(float(RANGE)))).cast("long")


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with _end, the range in which a partly taken size ends, and _need, the documents
    taken from that range."""
    part = plan.filter((F.col("_take") > 0) & (F.col("_take") < F.col("n")))
    cell = ["source", "size"]
    at = rows.join(part.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "_take"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    ranges = at.groupBy(*cell, "_take", _range(F.col("_h"), F.col("n")).alias("_end")).agg(F.count(F.lit(1)).alias("_m"))
    done = F.coalesce(F.sum("_m").over(Window.partitionBy(*cell).orderBy("_end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ranges.withColumn("_done", done).filter((F.col("_done") < F.col("_take")) & (F.col("_done") + F.col("_m") >= F.col("_take")))
    ends = ends.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_end", (F.col("_take") - F.col("_done")).alias("_need"))
    return plan.join(ends, plan["source"].eqNullSafe(ends["_s"]) & (plan["size"] == ends["_z"]), "left").drop("_s", "_z")


def _skinny(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return materialize(
        docs.select(
            docs[quoted(id_col)].alias("doc_id"),
            docs[quoted(source_col)].alias("source"),
            word_count(docs[quoted(text_col)]).alias("size"),
            seeded_order(docs[quoted(id_col)], docs[quoted(text_col)], seed).alias("_h"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-sizes",
    )


def _planned(rows: DataFrame) -> DataFrame:
    plan = materialize(plan_mix(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))), "mix-plan")
    return materialize(_ends(rows, plan), "mix-ends")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "source_size", "target", "_base", "_take", "_end", "_need")
    return rows.join(p, rows["source"].eqNullSafe(F.col("_s")) & (rows["size"] == F.col("_z"))).drop("_s", "_z").withColumn("_part", _range(F.col("_h"), F.col("n")))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and copies."""
    rows = _skinny(docs, id_col, text_col, source_col, seed)
    at = _with_plan(rows, _planned(rows))
    ranked = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_h", "_row")) <= F.col("_need")
    last = at.filter(F.col("_part") == F.col("_end")).withColumn("_in", ranked)
    rest = at.filter(F.col("_end").isNull() | (F.col("_part") != F.col("_end"))).withColumn(
        "_in", F.when(F.col("_end").isNull(), F.col("_take") > 0).otherwise(F.col("_part") < F.col("_end"))
    )
    copies = F.when(F.col("size") > 0, F.col("_base") + F.col("_in").cast("long")).otherwise(F.lit(0))
    return rest.unionByName(last).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"), "source")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all its columns.

    Instead of ranks each partly taken size has the seeded hash at which it ends, so texts
    are not shuffled to be ranked. Rows that tie on id and text have one hash; where only some
    of those at the end are taken, they alone are numbered, in the order of the input.
    """
    rows = _skinny(docs, id_col, text_col, source_col, seed)
    plan = _planned(rows)
    cell = ["source", "size"]
    order = Window.partitionBy(*cell).orderBy("_h")
    last = _with_plan(rows, plan.filter(F.col("_end").isNotNull())).filter(F.col("_part") == F.col("_end"))
    hashes = last.groupBy(*cell, "_need", "_h").agg(F.count(F.lit(1)).alias("_same")).withColumn("_upto", F.sum("_same").over(order))
    ends = hashes.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_same") < F.col("_need")))
    ends = ends.select(F.col("source").alias("_s1"), F.col("size").alias("_z1"), F.col("_h").alias("_stop"), "_same", (F.col("_need") - F.col("_upto") + F.col("_same")).alias("_left"))
    src, size, h, row, s1, z1, base, some, stop, same, left, copy = unused(docs.columns, "_src", "_size", "_h", "_row", "_s1", "_z1", "_base", "_any", "_stop", "_same", "_left", "_copy")
    stops = plan.join(ends, plan["source"].eqNullSafe(F.col("_s1")) & (plan["size"] == F.col("_z1")), "left").select(
        F.col("source").alias(s1), F.col("size").alias(z1), F.col("_base").alias(base), (F.col("_take") > 0).alias(some), F.col("_stop").alias(stop), F.col("_same").alias(same), F.col("_left").alias(left)
    )
    stops = materialize(stops, "mix-stops")
    text = docs[quoted(text_col)]
    keyed = docs.withColumns({size: word_count(text), h: seeded_order(docs[quoted(id_col)], text, seed), src: docs[quoted(source_col)], row: F.monotonically_increasing_id()})
    at = keyed.join(stops, F.col(src).eqNullSafe(F.col(s1)) & (F.col(size) == F.col(z1)))
    split = F.coalesce((F.col(h) == F.col(stop)) & (F.col(left) < F.col(same)), F.lit(False))

    def copied(found: DataFrame, inside: Column) -> DataFrame:
        copies = F.when(F.col(size) > 0, F.col(base) + inside.cast("long")).otherwise(F.lit(0)).cast("int")
        return found.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*map(quoted, docs.columns))

    whole = copied(at.filter(~split), F.col(some) & (F.col(stop).isNull() | (F.col(h) <= F.col(stop))))
    if stops.filter(F.col(left) < F.col(same)).isEmpty():
        return whole
    return whole.unionByName(copied(*_first_of_ties(at.filter(split), [src, size], row, left)))


def _first_of_ties(rows: DataFrame, cell: list[str], row: str, left: str) -> tuple[DataFrame, Column]:
    """Rows, written once, and whether they are among the first ``left`` of their cell by ``row``. They
    are numbered within the input's partitions, and those are counted, so no cell is one window."""
    part, n, before, *held = unused(rows.columns, "_part", "_n", "_before", "_s", "_z", "_p")
    tied = materialize(rows.withColumn(part, F.shiftright(F.col(row), 33)), "mix-ties")
    keys = [*cell, part]
    earlier = Window.partitionBy(*cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = tied.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    counts = counts.select(*(F.col(c).alias(k) for c, k in zip(keys, held, strict=True)), before)
    numbered = tied.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(row)))
    match = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, held, strict=True)]
    return numbered.join(counts, match[0] & match[1] & match[2]), F.col(before) + F.col(n) <= F.col(left)
