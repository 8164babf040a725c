"""Streams against the same rules over tables: any order of arrival, restarts, and time-outs."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.streaming import branches, followups, receipts

HOUR = 3_600_000_000


def feed(spark, rows, schema, path, files, last):
    """Rows as files in an order of their own, and ``last`` rows in one file after them."""
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    for k in range(files):
        spark.createDataFrame(shuffled[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)


def run(stream, at):
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{at}/out")


def branch_rows(seed, skip):
    draw = random.Random(seed)
    return [(k, 1_700_000_000_000_000 + k * 60_000_000 + draw.randrange(HOUR // 2), draw.choice([True, True, False, None])) for k in range(120) if k % 11 != skip]


def test_barrier_of_streams_is_that_of_tables(spark, tmp_path):
    schema, late = "job long, at_us long, ok boolean", [(None, 1_700_000_000_000_000 + 900 * HOUR, None)]
    log, signal = branch_rows(1, 4), branch_rows(2, 7) + [(500, 1_700_000_000_000_000, True), (None, 1_700_000_000_000_001, True), (501, None, True)]
    timed = lambda d: d.withColumn("at", F.timestamp_micros("at_us"))
    want = branches.branch_barrier(timed(spark.createDataFrame(log, schema)), timed(spark.createDataFrame(signal, schema)), "job", "at", "ok", "1 hour", "10 days")
    a = timed(feed(spark, log, schema, f"{tmp_path}/log", 4, late))
    b = timed(feed(spark, signal, schema, f"{tmp_path}/signal", 3, late))
    got = run(branches.branch_barrier(a, b, "job", "at", "ok", "1 hour", "10 days"), tmp_path)
    expected = sorted(map(tuple, want.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    found = {r[0]: r[1] for r in expected}
    assert len(expected) == 121 and found[500] == "log missing" and found[4].startswith("log missing") and "signal missing" in found[7]
    assert {"merge", "log failed", "signal failed", "both failed"} <= set(found.values())


def turns(seed, jobs):
    draw = random.Random(seed)
    out = []
    for k in range(jobs):
        start = 1_700_000_000_000_000 + draw.randrange(HOUR)
        if draw.random() < 0.8:
            out.append((f"j{k}", "report", None, start + draw.randrange(HOUR)))
        for seq in range(draw.randrange(6)):
            asked = start + draw.randrange(2 * HOUR)
            out.append((f"j{k}", "question", seq if draw.random() < 0.9 else None, asked))
            if draw.random() < 0.7:
                out.append((f"j{k}", "answer", seq, asked + draw.randrange(2 * HOUR)))
    return out + [(None, "question", 1, 5), ("j0", "other", 1, 5), ("j0", "report", 1, None)]


SCHEMA = "job string, kind string, seq long, at_us long"


def by_hand(rows, limit):
    """Steps through every event time and time-out of a job."""
    out = []
    for job in {r[0] for r in rows if r[0]}:
        mine = sorted(((r[3], ("question", "report", "answer").index(r[1]), 1 << 62 if r[2] is None else r[2]) for r in rows if r[0] == job and r[3] is not None and r[1] in ("question", "report", "answer")))
        reported, waiting, opened = False, [], None

        def expire(upto):
            nonlocal opened
            while opened and opened[1] + limit < upto:
                end = opened[1] + limit
                out.append((job, opened[0], opened[1], end, "expired"))
                opened = (waiting.pop(0), end) if waiting else None

        for at, kind, seq in mine:
            expire(at)
            if kind == 0:
                waiting.append(seq)
                waiting.sort()
            elif kind == 1:
                reported = True
            elif opened and opened[0] == seq:
                out.append((job, seq, opened[1], at, "answered"))
                opened = None
            if reported and not opened and waiting:
                opened = (waiting.pop(0), at)
        expire(1 << 62)
    return [(j, None if s == 1 << 62 else s, a, z, r) for j, s, a, z, r in out]


@pytest.mark.parametrize("seed", range(3))
def test_questions_of_a_table(spark, seed):
    rows = turns(seed, 80)
    got = followups.settle(spark.createDataFrame(rows, SCHEMA), limit=HOUR // 4).collect()
    key = lambda r: (r[0], r[2], r[3], repr(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(rows, HOUR // 4), key=key)
    assert {"answered", "expired"} == {r["result"] for r in got}
    for job in {r["job"] for r in got}:  # one open at a time
        spans = sorted((r["opened_us"], r["closed_us"]) for r in got if r["job"] == job)
        assert all(z <= a for (_, z), (a, _) in zip(spans, spans[1:], strict=False))


def test_questions_of_a_stream(spark, tmp_path):
    rows = turns(5, 40)
    stream = feed(spark, rows, SCHEMA, f"{tmp_path}/in", 5, [("tick", "report", None, 1_700_000_000_000_000 + 9000 * HOUR)])
    got = run(followups.settle_stream(stream, "30 days", limit=HOUR // 4), tmp_path)
    key = lambda r: (r[0], r[2], r[3], repr(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, HOUR // 4), key=key)


def test_batches_are_published_once_and_whole(spark, tmp_path):
    rows, schema = [(k, f"v{k % 7}" if k % 5 else None) for k in range(200)], "id long, _source string"
    for k in range(4):
        spark.createDataFrame(rows[k::4] + rows[:1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = spark.read.parquet(f"{tmp_path}/in").schema
    at = f"{tmp_path}/sink"
    fails = {1: 2}  # batch 1 dies twice between data and receipt

    def die(number):
        if fails.get(number, 0):
            fails[number] -= 1
            raise RuntimeError("killed")

    def start():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(receipts.receipt_sink(at, die)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            start()
        seen = receipts.published(spark, at, kind)
        assert seen.select("batch").distinct().collect() == [(0,)] and seen.count() == 51
        assert spark.read.parquet(f"{at}/data").select("batch").distinct().count() == 2  # written, not published
    start()
    seen = receipts.published(spark, at, kind)
    assert sorted(((r["id"], r["_source"]) for r in seen.collect()), key=repr) == sorted(rows + rows[:1] * 4, key=repr)
    told = receipts.receipts(spark, at)
    assert told.count() == 4 and told.agg(F.sum("rows")).first()[0] == 204 and told.select("source").distinct().count() == 4
    before = sorted(map(repr, told.collect()))
    receipts.receipt_sink(at)(spark.createDataFrame([(1, "x")], kind), 2)  # a batch that comes again
    assert sorted(map(repr, receipts.receipts(spark, at).collect())) == before and receipts.published(spark, at, kind).count() == 204


def test_nothing_published_yet(spark, tmp_path):
    kind = spark.createDataFrame([], "id long").schema
    assert receipts.published(spark, f"{tmp_path}/none", kind).count() == 0 and receipts.receipts(spark, f"{tmp_path}/none").count() == 0
