"""Spark-first engine for correlating two event logs of one entity over a bounded window,
and for the integrity, reconciliation and task-state work around it."""
