"""The barrier between two branches of a job, over streams or tables alike.

Each branch sends one row for each job when it has ended: job, time, passed. The barrier closes a job
when both are there, or when one has stayed away for longer than ``within``: a branch that fails
or never comes blocks the merge but not the job's end. It is one full outer join on job and a
span of time, so a stream keeps only the jobs that are still open.

Defined results: a null ``passed`` is a failure; null jobs or times close nothing and are left out; a
branch that repeats a job closes it once for each pair, as a table's join does. Rows that are
later than ``horizon`` behind the newest of both streams are dropped by Spark, so the horizon is
at least the length of the task. A stream closes what is open only as its time goes on: at the
end of a bounded one, ``tick`` rows (no job, a late time) on both sides say that nothing follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _branch(rows: DataFrame, job: str, time: str, passed: str, side: str, horizon: str) -> DataFrame:
    found = rows.select(F.col(job).alias(f"{side}_job"), F.col(time).cast("timestamp").alias(f"{side}_at"), F.coalesce(F.col(passed), F.lit(False)).alias(f"{side}_passed"))
    found = found.filter(F.col(f"{side}_at").isNotNull())
    return found.withWatermark(f"{side}_at", horizon) if rows.isStreaming else found.filter(F.col(f"{side}_job").isNotNull())


def verdict(log: Column, signal: Column, has_log: Column, has_signal: Column) -> Column:
    return (
        F.when(~has_log, F.when(signal, "log missing").otherwise("log missing, signal failed"))
        .when(~has_signal, F.when(log, "signal missing").otherwise("log failed, signal missing"))
        .when(log & signal, "merge").when(log, "signal failed").when(signal, "log failed").otherwise("both failed")
    )


def branch_barrier(log: DataFrame, signal: DataFrame, job: str, time: str, passed: str, within: str, horizon: str) -> DataFrame:
    """(job, verdict, log_us, signal_us): ``merge`` where both branches passed, else which failed or
    stayed away. ``within`` and ``horizon`` are intervals, as '1 hour'."""
    a = _branch(log, job, time, passed, "log", horizon)
    b = _branch(signal, job, time, passed, "signal", horizon)
    near = F.expr(f"log_job = signal_job AND signal_at >= log_at - INTERVAL {within} AND signal_at <= log_at + INTERVAL {within}")
    found = a.join(b, near, "full_outer").filter(F.col("log_job").isNotNull() | F.col("signal_job").isNotNull())
    said = verdict(F.col("log_passed"), F.col("signal_passed"), F.col("log_job").isNotNull(), F.col("signal_job").isNotNull())
    return found.select(F.coalesce("log_job", "signal_job").alias("job"), said.alias("verdict"), F.unix_micros("log_at").alias("log_us"), F.unix_micros("signal_at").alias("signal_us"))
