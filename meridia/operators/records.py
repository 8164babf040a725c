"""De-duplication, labels, source selection and the state of tasks.

A null key is a key like any other, but for joins, where it matches nothing. Null outcomes,
environments and states count as none of the named ones. Repeated rows are repeated events,
but where an operator says that it keeps one. Empty tables give empty results. Extra columns
are carried along where rows are returned, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.names import unused
from meridia.functions.scratch import work_dir

from .history import with_row_before, with_running_sum

#: Rows that a task adds up by nearly unique keys.
ROWS = 250_000


def distinct_points(points: DataFrame) -> DataFrame:
    """One row for each complete point; points that differ in any column stay."""
    return points.dropDuplicates()


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as a map-side combined minimum."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_x")
    return rows.groupBy(*key).agg(best).select(*(c if c in key else F.col(f"_x.{c}") for c in rows.columns))


def last_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_x")
    return rows.groupBy(*key).agg(best).select(*(c if c in key else F.col(f"_x.{c}") for c in rows.columns))


def with_label(rows: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    """Adds ``label``: the code's label, or the code itself. ``labels`` (code, label) is a
    dimension; Spark broadcasts it only if it is small. A column ``label`` of the rows is replaced."""
    c, text = unused(rows.columns, "_c", "_l")
    named = labels.select(F.col("code").alias(c), F.col("label").alias(text))
    return rows.join(named, F.col(code) == F.col(c), "left").withColumn("label", F.coalesce(F.col(text), F.col(code).cast("string"))).drop(c, text)


def unknown_codes(rows: DataFrame, code: str, known: DataFrame) -> DataFrame:
    """Codes that the dictionary lacks, and how often they occur."""
    counted = rows.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known.select(F.col("code").alias(code)), code, "left_anti")


def choose_source(attempts: DataFrame, job: list[str]) -> DataFrame:
    """Of each job's attempts (env, outcome): an error of the primary source stands; only a
    successful but empty or missing answer turns to the fallback. ``chosen`` is primary,
    fallback, none or error, and never a mixture of environments."""
    flag = lambda env, *what: F.max(((F.col("env") == env) & F.col("outcome").isin(*what)).cast("int")) == 1
    facts = attempts.groupBy(*job).agg(
        flag("primary", "error").alias("_pe"), flag("primary", "ok").alias("_po"), flag("fallback", "error").alias("_fe"), flag("fallback", "ok").alias("_fo"),
        F.count(F.lit(1)).alias("attempts"),
    )
    chosen = F.when(F.col("_pe"), "error").when(F.col("_po"), "primary").when(F.col("_fe"), "error").when(F.col("_fo"), "fallback").otherwise("none")
    return facts.select(*job, "attempts", chosen.alias("chosen"))


def one_environment(rows: DataFrame, job: list[str], env: str) -> DataFrame:
    """Jobs with the number of environments their branches come from."""
    n = F.count_distinct(env)
    return rows.groupBy(*job).agg(n.alias("environments"), (n == 1).alias("consistent"))


def complete_pages(rows: DataFrame, job: list[str], page: str, total: str | None = None) -> DataFrame:
    """Jobs all of whose pages arrived. Without a column ``total`` a job expects as many pages as it has rows.

    Pages are nearly unique, so adding up before the shuffle would hold a table of all that a task reads.
    Rows are dealt out by job and page instead, ``ROWS`` to a task however many there are (one scan
    counts them), so no task's memory grows with the table, and a job of many pages is many tasks."""
    p, n = unused(job, "_page", "_n")
    values = (F.col(page).alias(p), (F.lit(1) if total is None else F.col(total)).alias(n))
    dealt = rows.select(*job, *values).repartition(1 + rows.count() // ROWS, *job, p)
    add = F.sum if total is None else F.max
    return dealt.groupBy(*job, p).agg(add(n).alias(n)).groupBy(*job).agg(F.count(p).alias("pages"), add(n).alias("expected"), (F.count(p) == add(n)).alias("complete"))


def pick_attempt(attempts: DataFrame, job: list[str], order: list[str], ok: Column, final: Column, most: int = 3) -> DataFrame:
    """First success among the first ``most`` attempts, unless a failure that must not be
    retried came before it. Each job's result: attempt number or null, and a status."""
    ok_, final_, n = unused(attempts.columns, "_ok", "_final", "_n")
    w = Window.partitionBy(*job).orderBy(*order)
    rows = attempts.withColumns({ok_: ok, final_: final}).withColumn(n, F.row_number().over(w).cast("long")).filter(F.col(n) <= most)
    facts = rows.groupBy(*job).agg(F.min(F.when(F.col(ok_), F.col(n))).alias("_first"), F.min(F.when(F.col(final_), F.col(n))).alias("_stop"), F.count(F.lit(1)).alias("tried"))
    won = F.col("_first").isNotNull() & (F.col("_stop").isNull() | (F.col("_first") < F.col("_stop")))
    status = F.when(won, "ok").when(F.col("_stop").isNotNull(), "refused").otherwise("exhausted")
    return facts.select(*job, F.when(won, F.col("_first")).alias("attempt"), status.alias("status"), "tried")


def fair_order(tasks: DataFrame, requester: str, time: str, task: str) -> DataFrame:
    """Round-robin over requesters: round (the requester's n-th task) and position in the
    whole order (round, time, task). Tasks without a time come first in their round. The order
    is a sort over the cluster, so a round that holds many tasks is many ranges of it."""
    rounds = with_running_sum(tasks, [requester], time, task, F.lit(1), "round")
    return sorted_in_tasks(rounds, [], ["round", time, task], "position")


def admitted(tasks: DataFrame, requester: str, time: str, task: str, slots: int) -> DataFrame:
    """The tasks that get the free slots: a top-k over the fair order."""
    return with_running_sum(tasks, [requester], time, task, F.lit(1), "round").orderBy("round", time, task).limit(slots)


def binding(rows: DataFrame, thread: list[str], job: str) -> DataFrame:
    """A thread's job if exactly one is bound to it; several are ambiguous, never 'latest'."""
    facts = rows.groupBy(*thread).agg(F.count_distinct(job).alias("jobs"), F.min(job).alias("_j"))
    return facts.select(*thread, "jobs", F.when(F.col("jobs") == 1, F.col("_j")).alias("job"), F.when(F.col("jobs") == 1, "bound").otherwise("ambiguous").alias("status"))


def next_unfinished(items: DataFrame, job: str, seq: str, done: Column) -> DataFrame:
    """Each job's queue head: smallest unfinished number; null where all is answered."""
    return items.groupBy(job).agg(F.min(F.when(~done, F.col(seq))).alias("next_seq"), F.sum((~done).cast("long")).alias("waiting"))


def delivery_status(artifacts: DataFrame, receipts: DataFrame, key: str, bound: tuple[str, ...] = ()) -> DataFrame:
    """'sent' only with a confirmed receipt of the same hash, size and ``bound`` columns (receiver,
    source); an unknown result is a state of its own; anything else is pending or failed. (key,
    sha256, bytes, bound) on both sides, ``result`` on receipts. Nulls agree with nulls alone."""
    facts = ["sha256", "bytes", *bound]
    k, result, *held = unused([key, *facts], "_k", "_result", *(f"_fact{i}" for i in range(len(facts))))
    r = receipts.select(F.col(key).alias(k), F.col("result").alias(result), *(F.col(c).alias(h) for c, h in zip(facts, held, strict=True)))
    same = F.lit(True)
    for c, h in zip(facts, held, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    facts = artifacts.select(key, *facts).join(r, F.col(key) == F.col(k), "left").groupBy(key).agg(
        has(same & (F.col(result) == "confirmed")).alias("_sent"), has(F.col(result) == "unknown").alias("_unknown"),
        has(F.col(result) == "failed").alias("_failed"), has(F.col(k).isNotNull()).alias("_any"),
    )
    status = F.when(F.col("_sent"), "sent").when(F.col("_unknown"), "unknown").when(F.col("_failed"), "delivery_failed").when(F.col("_any"), "unproven").otherwise("pending")
    return facts.select(key, status.alias("status"))


def resend_plan(status: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Completed artifacts that may be sent again as they are ('resend'), and those whose
    receipt must be looked up first ('check')."""
    open_ = status.filter(F.col("status").isin("delivery_failed", "unproven", "unknown"))
    return open_.join(completed.select(key), key, "left_semi").select(key, F.when(F.col("status") == "unknown", "check").otherwise("resend").alias("action"))


def recovery_plan(branches: DataFrame, job: str, branch: str, ok: Column, finished: DataFrame, leased: DataFrame, recorded: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Jobs whose log branch is done and whose signal branch is not, without a final report
    and without a lease that another worker may hold. With ``recorded`` (a row for each job: what it
    was bound to, as hashes) only jobs for which ``seen`` has the same in all of its columns; a job
    that either lacks isn't resumed, nulls agree with nulls alone."""
    done = lambda name: F.max(((F.col(branch) == name) & ok).cast("int")) == 1
    facts = branches.groupBy(job).agg(done("log").alias("_log"), done("signal").alias("_signal"))
    plan = facts.filter("_log AND NOT _signal").select(job).join(finished.select(job), job, "left_anti").join(leased.select(job), job, "left_anti")
    if recorded is None or seen is None:
        return plan
    columns = [job, *(c for c in recorded.columns if c != job)]
    held = unused(columns, *(f"_seen{k}" for k in range(len(columns))))
    now = seen.select(*(F.col(c).alias(h) for c, h in zip(columns, held, strict=True)))
    same = F.lit(True)
    for c, h in zip(columns, held, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    return plan.join(recorded.select(*columns).join(now, F.col(job).eqNullSafe(F.col(held[0])) & same, "left_semi").select(job), job, "left_semi")


def expired(rows: DataFrame, day: str, keep_days: int) -> DataFrame:
    """Rows over ``keep_days`` older than the newest row: a plan, nothing is deleted."""
    newest = rows.agg(F.max(day)).scalar()
    return rows.filter(F.datediff(newest, F.col(day)) > keep_days)


def transitions(rows: DataFrame, key: str, time: str, tie: str, state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Counts of state changes, and whether each is allowed."""
    pairs = with_row_before(rows, [key], time, tie, state, "from_state").filter(F.col("from_state").isNotNull())
    counts = pairs.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    fine = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    return counts.withColumn("allowed", F.array_contains(fine, F.concat_ws(">", "from_state", "to_state")))


def same_window(log: DataFrame, signal: DataFrame, job: str, parts: list[str]) -> DataFrame:
    """Each job of either branch with the first of ``parts`` (vehicle, window, environment) in
    which its branches differ, 'missing branch' where one has none, or 'same'."""
    a, b, has_a, has_b = unused([*log.columns, *signal.columns], "_a", "_b", "_has_a", "_has_b")
    left = log.select(job, F.struct(*parts).alias(a), F.lit(True).alias(has_a))
    right = signal.select(job, F.struct(*parts).alias(b), F.lit(True).alias(has_b))
    verdict = F.when(F.col(has_a).isNull() | F.col(has_b).isNull(), "missing branch")
    for part in parts:
        verdict = verdict.when(~F.col(a)[part].eqNullSafe(F.col(b)[part]), part)
    return left.join(right, job, "full").select(job, verdict.otherwise("same").alias("verdict"))


def sorted_in_tasks(rows: DataFrame, job: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows sorted by job and ``order`` over the cluster, with ``name``, the row's number in its job.
    Without job columns all rows are one job.

    Partitions are ranges of (job, order), so a job that holds a large share of all rows is many
    tasks, each sorted outside memory. A task numbers its rows job by job; of the jobs in a partition
    only the first can go on from earlier ones, so what has to be added is one row for each partition
    at most, which is broadcast. The sorted rows are written once, as the ranges of a shuffle that
    is made again may differ. Rows that tie on job and order share a partition. Null jobs are a
    job, null orders come first; a column ``name`` is replaced."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c.lower() != name.lower()]
    part, before, *held = unused([*columns, name], "_part", "_before", *(f"_job{k}" for k in range(len(job))))
    names = [*columns, name, part]
    kind = T.StructType([*rows.select(*columns).schema.fields, T.StructField(name, T.LongType()), T.StructField(part, T.IntegerType())])

    def number(batches):
        last, seen, own = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in job:
                codes = batch.column(names.index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            key = lambda k, batch=batch: tuple(batch.column(names.index(c))[k].as_py() for c in job)
            starts = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(starts, np.diff([*starts, n])) + 1
            if key(0) == last:
                place[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = key(n - 1), int(place[-1])
            yield pa.record_batch([*batch.columns, pa.array(place.astype(np.int64)), pa.array(np.full(n, own, np.int32))], names)

    at = f"{work_dir(spark)}/sorted"
    keys = [F.col(c) for c in [*job, *order]]
    rows.select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, kind).write.parquet(at)
    written = spark.read.schema(kind).parquet(at)
    counts = written.groupBy(*job, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*job).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    goes_on = counts.withColumn(before, F.sum(before).over(earlier)).filter(F.col(before) > 0)
    goes_on = goes_on.select(*(F.col(c).alias(h) for c, h in zip(job, held, strict=True)), F.col(part).alias(f"{part}_of"), before)
    same = F.col(part) == F.col(f"{part}_of")
    for c, h in zip(job, held, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    found = written.join(F.broadcast(goes_on), same, "left")
    return found.select(*columns, (F.col(name) + F.coalesce(before, F.lit(0))).alias(name))


def gate(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys for which both branches passed; a branch that failed blocks the merge."""
    return left.filter("passed").select(*key).join(right.filter("passed").select(*key), key, "left_semi")


def takeover_plan(jobs: DataFrame, job: str) -> DataFrame:
    """Interrupted jobs that may be taken over: the old process and its children are gone, the
    source is valid, there is no final report, and the lease is still the one seen. The first
    condition that fails is named, so a refusal can be explained. (process_gone, children_gone,
    source_valid, has_report, lease_seen, lease_now)"""
    reason = (
        F.when(~F.col("process_gone"), "process alive").when(~F.col("children_gone"), "children alive")
        .when(~F.col("source_valid"), "source invalid").when(F.col("has_report"), "already reported")
        .when(~F.col("lease_seen").eqNullSafe(F.col("lease_now")), "lease changed").otherwise("take over")
    )
    return jobs.select(job, F.coalesce(reason, F.lit("unknown")).alias("decision"))


def with_followup(reports: DataFrame, registrations: DataFrame, job: str) -> DataFrame:
    """Reports with their follow-up registration. A failed or missing registration is noted
    and never removes the report."""
    [r] = unused(reports.columns, "_r")
    known = registrations.groupBy(job).agg(F.max(F.col("registered").cast("int")).alias(r))
    state = F.when(F.col(r) == 1, "available").when(F.col(r) == 0, "registration failed").otherwise("not registered")
    return reports.join(known, job, "left").withColumn("followup", state).drop(r)


def route(message: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Task of a message by a rule table of (pattern, task) in order: the first that matches."""
    task = F.lit(otherwise)
    for pattern, name in reversed(rules):
        task = F.when(message.rlike(pattern), name).otherwise(task)
    return task
