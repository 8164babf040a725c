"""Decoding against a bit by bit one."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.operators import signals

ENTRY = "signal string, message long, version string, start int, length int, byte_order string, signed boolean, factor double, offset double, unit string, from_us long, to_us long"


def by_bits(payload, start, length, order, signed):
    places, at = [], start
    for _ in range(length):  # (byte, bit) of the field, in reading order
        places.append((at // 8, at % 8))
        if order == "little":
            at += 1
        else:
            at = at - 1 if at % 8 else at + 15
    if any(byte >= len(payload) for byte, _ in places):
        return None
    bits = [payload[byte] >> bit & 1 for byte, bit in places]
    bits = bits if order == "big" else bits[::-1]  # highest first
    n = int("".join(map(str, bits)), 2)
    return n - (1 << length) if signed and bits[0] else n


def entry(name, message, start, length, order, signed=False, version="1", begin=None, end=None):
    return (name, message, version, start, length, order, signed, 0.5, -3.0, "u", begin, end)


@pytest.mark.parametrize("seed", range(3))
def test_fields_bit_by_bit(spark, seed):
    draw = random.Random(seed)
    entries = [entry(f"s{k}", draw.randrange(4), draw.randrange(64), draw.randint(1, 63), draw.choice(["little", "big"]), draw.random() < 0.5) for k in range(60)]
    frames = [(k, draw.randrange(4), draw.randrange(10**15), bytearray(draw.randbytes(draw.choice([0, 1, 3, 8, 12])))) for k in range(40)]
    frames += [(99, 1, 5, None)]
    found = signals.decode(spark.createDataFrame(frames, "id long, message long, ts_us long, payload binary"), spark.createDataFrame(entries, ENTRY)).collect()
    got = sorted((r["id"], r["signal"], r["raw"], r["value"], r["status"]) for r in found)
    want = []
    for i, m, _, payload in frames:
        for name, message, _, start, length, order, signed, factor, offset, *_ in entries:
            if m == message:
                raw = by_bits(payload or b"", start, length, order, signed)
                want.append((i, name, raw, None if raw is None else raw * factor + offset, "short_payload" if raw is None else "ok"))
    assert len(got) == len(want) > 300
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_versions_hold_in_their_span(spark, monkeypatch):
    day = 86_400_000_000
    entries = [entry("a", 1, 0, 8, "little", version="1", end=100 * day), entry("a", 1, 8, 8, "little", version="2", begin=100 * day, end=200 * day), entry("a", 1, 0, 4, "little", version="3", begin=300 * day), entry("b", 2, 0, 8, "other"), entry("c", 2, 0, 64, "big"), entry("d", None, 0, 8, "big")]
    frames = [(k, 1, t, bytearray([17, 34])) for k, t in enumerate([-5, 0, 100 * day - 1, 100 * day, 200 * day - 1, 200 * day, 300 * day - 1, 300 * day, 5000 * day])]
    frames += [(20, 2, 7, bytearray([1])), (21, 3, 7, bytearray([1])), (22, None, 7, bytearray([1])), (23, 1, None, bytearray([1, 2]))]
    rows = spark.createDataFrame(frames, "id long, message long, ts_us long, payload binary").withColumns({"_entry": F.lit(1), "_bucket": F.lit(2), "status": F.lit("theirs"), "_own": F.lit(3)})
    for bucket in (signals.BUCKET, 7 * day):
        out = signals.decode(rows, spark.createDataFrame(entries, ENTRY), bucket=bucket)
        got = sorted((r["id"], r["version"], r["raw"], r["status"]) for r in out.collect() if r["id"] < 20 or r["signal"] is None)
        assert got[:9] == [(0, "1", 17, "ok"), (1, "1", 17, "ok"), (2, "1", 17, "ok"), (3, "2", 34, "ok"), (4, "2", 34, "ok"), (5, None, None, "no_version"), (6, None, None, "no_version"), (7, "3", 1, "ok"), (8, "3", 1, "ok")]
        assert got[9:] == [(21, None, None, "unknown_message"), (22, None, None, "unknown_message"), (23, None, None, "no_version")]
        bad = [r for r in out.collect() if r["id"] == 20]
        assert sorted((r["signal"], r["status"]) for r in bad) == [("b", "bad_entry"), ("c", "bad_entry")]
        assert {(r["_entry"], r["_bucket"], r["_own"]) for r in bad} == {(1, 2, 3)}
    assert signals.decode(rows.limit(0), spark.createDataFrame(entries, ENTRY)).count() == 0
    assert {r["status"] for r in signals.decode(rows, spark.createDataFrame([], ENTRY)).collect()} == {"unknown_message"}


def test_dictionary_is_checked(spark):
    entries = spark.createDataFrame([entry("a", 1, 0, 8, "little", end=100), entry("a", 1, 0, 8, "little", version="2", begin=90), entry("b", 9, 0, 8, "big")], ENTRY)
    frames = spark.createDataFrame([(1, 1, 5, bytearray([1])), (2, 1, 6, bytearray())], "id long, message long, ts_us long, payload binary")
    got = signals.dictionary_check(signals.decode(frames, entries), entries, [])
    assert sorted(map(tuple, got.collect())) == [("a", "1", "ok", 1), ("a", "1", "short_payload", 1), ("a", "2", "never_met", 0), ("b", "1", "never_met", 0)]
    assert [tuple(r) for r in signals.coverage(entries).collect()] == [(1, "a", "1", "2")]
