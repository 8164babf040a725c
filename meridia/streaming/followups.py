"""Follow-up questions behind the finished report, one at a time, with a time-out.

A job's turns are events: ``report`` (the standard report is finished), ``question`` (seq) and
``answer`` (seq). Questions wait for the report; then the one of smallest seq is opened, and the next
one only when it is answered or has been open for ``limit`` (900 s). An answer at exactly the limit
counts. Answers to what isn't open change nothing.

The same rules run over a table (``settle``: each job's turns at once) and over a stream
(``settle_stream``: keyed state with event-time timers). The stream holds back a job's turns until
the watermark has passed them, so turns in any order of arrival within the horizon give what the
table gives. A job's state goes when it has been quiet for ``keep`` with nothing open.

Defined results: null jobs are left out, as are turns without a time or a known kind; questions
without seq come last in their job; a seq that repeats is a question of its own; a job without a
report opens nothing. Times are microseconds. Empty tables give empty results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, KEEP = 900_000_000, 14 * 86_400_000_000
OUT = "job string, seq long, opened_us long, closed_us long, result string"
_KINDS = ("question", "report", "answer")  # the order of turns of one time
_LAST = 1 << 62


class Queue:
    """One job's questions: what waits, what is open, and turns whose time hasn't come."""

    def __init__(self, held: str | None = None):
        x = json.loads(held) if held else {}
        self.reported: bool = x.get("reported", False)
        self.waiting: list[int] = x.get("waiting", [])
        self.open: list[int] | None = x.get("open")  # (seq, opened)
        self.turns: list[list[int]] = x.get("turns", [])  # (time, kind, seq)
        self.newest: int = x.get("newest", 0)

    def text(self) -> str:
        return json.dumps(self.__dict__, separators=(",", ":"))

    def add(self, kind: str, seq: int | None, at: int) -> None:
        self.turns.append([at, _KINDS.index(kind), _LAST if seq is None else seq])
        self.newest = max(self.newest, at)

    def _next(self, at: int) -> None:
        self.open = None
        if self.reported and self.waiting:
            self.waiting.sort()
            self.open = [self.waiting.pop(0), at]

    def advance(self, before: int | None, limit: int) -> Iterator[tuple[int, int, int, str]]:
        """(seq, opened, closed, result) of what closes at times below ``before`` (None: ever)."""
        self.turns.sort()
        while True:
            at = self.turns[0][0] if self.turns else None
            if self.open and (at is None or at > self.open[1] + limit):
                seq, opened = self.open
                if before is not None and opened + limit >= before:
                    return
                yield seq, opened, opened + limit, "expired"
                self._next(opened + limit)
                continue
            if at is None or (before is not None and at >= before):
                return
            _, kind, seq = self.turns.pop(0)
            if _KINDS[kind] == "report":
                self.reported = True
            elif _KINDS[kind] == "question":
                self.waiting.append(seq)
            elif self.open and self.open[0] == seq:
                yield seq, self.open[1], at, "answered"
                self._next(at)
            if not self.open:
                self._next(at)

    def due(self, limit: int, keep: int) -> int:
        """The next time at which something happens by itself."""
        times = [t[0] for t in self.turns] + ([self.open[1] + limit] if self.open else [])
        return min(times) if times else self.newest + keep


def _turns(rows: DataFrame) -> DataFrame:
    some = rows.filter(F.col("job").isNotNull() & F.col("at_us").isNotNull() & F.col("kind").isin(*_KINDS))
    return some.select(F.col("job").cast("string").alias("job"), "kind", F.col("seq").cast("long").alias("seq"), F.col("at_us").cast("long").alias("at_us"))


def _rows(job: str, found: list[tuple[int, int, int, str]]) -> pd.DataFrame:
    columns = {"job": [job] * len(found), "seq": [None if f[0] == _LAST else f[0] for f in found], "opened_us": [f[1] for f in found], "closed_us": [f[2] for f in found], "result": [f[3] for f in found]}
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


def settle(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(job, seq, opened_us, closed_us, result) of every question that was opened, from a table of
    (job, kind, seq, at_us) that holds all turns. One job's turns are one group: a conversation."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        queue = Queue()
        for kind, seq, at in zip(rows["kind"], rows["seq"], rows["at_us"], strict=True):
            queue.add(kind, None if pd.isna(seq) else int(seq), int(at))
        return _rows(key[0], list(queue.advance(None, limit)))

    return _turns(turns).groupBy("job").applyInPandas(run, OUT)


class _Processor(StatefulProcessor):
    def __init__(self, limit: int, keep: int):
        self.limit, self.keep = limit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "held string")

    def _run(self, key, queue: Queue, timers) -> Iterator[pd.DataFrame]:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        found = list(queue.advance(watermark, self.limit))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not queue.turns and not queue.open and queue.newest + self.keep < watermark:
            self.state.clear()
        else:
            self.state.update((queue.text(),))
            # a millisecond after what is next, as timers count in those
            self.handle.registerTimer(max(queue.due(self.limit, self.keep), watermark) // 1000 + 1)
        if found:
            yield _rows(key[0], found)

    def _queue(self) -> Queue:
        return Queue(self.state.get()[0] if self.state.exists() else None)

    def handleInputRows(self, key, rows, timerValues):
        queue = self._queue()
        for part in rows:
            for kind, seq, at in zip(part["kind"], part["seq"], part["at_us"], strict=True):
                queue.add(kind, None if pd.isna(seq) else int(seq), int(at))
        yield from self._run(key, queue, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._run(key, self._queue(), timerValues)

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle_stream(turns: DataFrame, horizon: str, limit: int = LIMIT, keep: int = KEEP) -> DataFrame:
    """``settle`` over a stream of turns. Timers need the state store that keeps columns by name, so the
    session's store is set to it. A turn of a job of its own with a late time, as a ``tick``, moves
    the time on at the end of a bounded stream."""
    turns.sparkSession.conf.set(STORE, ROCKS)
    timed = _turns(turns).withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", horizon)
    return timed.groupBy("job").transformWithStateInPandas(_Processor(limit, keep), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
