"""Signals decoded from payload bytes by a dictionary.

A dictionary row says where a signal lies in the payload of a message, and how its raw number
becomes a value: signal, message, version, start bit, length in bits, byte order (``little`` or
``big``), whether it is signed, factor, offset, unit, and the span of time (from_us inclusive, to_us
exclusive; null is open) in which this version of the dictionary holds.

Little-endian fields count bits from the lowest of byte 0 upwards: ``start`` is their lowest bit.
Big-endian ones (of which ``start`` is the highest bit, in the same count of byte and bit) go on
in the next byte's highest bit. Fields have 1 to 63 bits. All arithmetic is Spark's own, on the
bytes that a field touches; nothing is decoded in Python.

Defined results: frames that no entry of their message covers come out with the status
``unknown_message``; ones whose message is known, but in no version at their time,
``no_version``; a field beyond the payload's end ``short_payload``; entries that can't be read
``bad_entry``; else ``ok``. Overlapping versions each give a row. Null payloads have no bytes, null
messages and times match nothing. Empty tables give empty results. Extra columns of the frames go
along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.names import quoted, unused

#: What of an entry goes along with the frames, besides its place.
FIELDS = ("signal", "version", "factor", "offset", "unit", "from_us", "to_us")
#: Width of the buckets in which frames and versions meet.
BUCKET = 30 * 86_400_000_000


def readable(start: Column, length: Column, order: Column) -> Column:
    """Whether an entry describes a field."""
    fine = (start >= 0) & length.between(1, 63) & order.isin("little", "big")
    return F.coalesce(fine, F.lit(False))


def _ones(length: Column) -> Column:
    """The number of so many bits that are all 1."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - length).cast("int"))


def digits(payload: Column) -> tuple[Column, Column]:
    """The payload's hexadecimal digits with nine more bytes of 0 behind it; and with its last byte
    first, and the bytes of 0 before. Made once for each frame, for all its fields."""
    text = F.hex(payload)
    return F.concat(text, F.lit("0" * 18)), F.concat(F.lit("0" * 18), F.regexp_replace(F.reverse(text), "(.)(.)", "$2$1"))


def place(start: Column, length: Column, order: Column, signed: Column) -> Column:
    """Where a field's bits lie in the digits, for each entry once and not for each frame: ``at``, the first
    of the 18 digits that hold the field (from the end where bytes are read backwards); ``over``, as many
    digits as there are more than; ``right``, bits behind the field in them; ``ones``, the field's bits;
    ``sign``, the highest of them where the number is signed."""
    big = order == "big"
    first, bit = F.call_function("shiftright", start, F.lit(3)), start.bitwiseAND(7)
    before = F.when(big, 7 - bit).otherwise(bit)  # bits of the first byte before the field, in reading direction
    last = first + F.call_function("shiftright", before + length - 1, F.lit(3))
    return F.struct(
        # 63 bits touch nine bytes at most: from the first one on, or back to it
        F.when(big, 2 * first + 1).otherwise(-2 * (first + 9)).cast("int").alias("at"),
        (2 * (last + 9)).alias("over"),
        F.when(big, 72 - before - length).otherwise(before).cast("int").alias("right"),
        _ones(length).alias("ones"),
        F.when(F.coalesce(signed, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), (length - 1).cast("int"))).otherwise(F.lit(0).cast("long")).alias("sign"),
    )


def field(forward: Column, backward: Column, where: Column) -> Column:
    """The number that the field's bits stand for, from the payload's digits; in two's complement where it
    is signed; null where the payload ends before the field."""
    right, sign = where["right"], where["sign"]
    window = F.substring(F.when(where["at"] > 0, forward).otherwise(backward), where["at"], F.lit(18))
    high, low = (F.conv(F.substring(window, at, 9), 16, 10).cast("long") for at in (1, 10))  # 36 bits each
    shift = lambda way, c, n: F.call_function(f"shift{way}", c, n)
    moved = F.when(right >= 36, shift("right", high, right - 36)).otherwise(shift("left", high, 36 - right).bitwiseOR(shift("right", low, right)))
    return F.when(F.length(forward) > where["over"], moved.bitwiseAND(where["ones"]).bitwiseXOR(sign) - sign)


def decode(frames: DataFrame, dictionary: DataFrame, message: str = "message", time: str = "ts_us", payload: str = "payload", bucket: int = BUCKET) -> DataFrame:
    """Frames with signal, version, unit, raw, value and status: a row for each frame and entry that
    holds at its time, and one for each frame without any.

    Versions are spans of time, so this is a range join: entries are sent to the buckets of
    time that their span touches within the frames' own range, and meet the frames by (message, bucket).
    A dictionary is small beside its frames, and Spark broadcasts it if it is small enough; a
    message that holds a large share of all frames is then no hot key, else the skew join cuts it.
    """
    taken = frames.columns
    e, b, m, own, ahead, back = unused(taken, "_entry", "_bucket", "_message", "_own", "_ahead", "_back")
    [signal] = [F.col(e)]
    at, sent_bytes = F.col(quoted(time)), F.col(quoted(payload))
    where = F.when(readable(F.col("start"), F.col("length"), F.col("byte_order")), place(*map(F.col, ("start", "length", "byte_order", "signed"))))
    entries = dictionary.select(F.col("message").alias(m), F.struct(*FIELDS, where.alias("place")).alias(e)).filter(F.col(m).isNotNull())
    known = entries.select(m).distinct().withColumn(own, F.lit(True))
    low, high = (f(F.floor(at / bucket)) for f in (F.min, F.max))
    span = frames.select(low.alias("low"), high.alias("high")).first()  # two numbers
    low, high = (0, -1) if span["low"] is None else (span["low"], span["high"])
    begins = F.greatest(F.lit(low), F.coalesce(F.floor(signal["from_us"] / bucket), F.lit(low)))
    ends = F.least(F.lit(high), F.coalesce(F.floor((signal["to_us"] - 1) / bucket), F.lit(high)))
    sent = entries.filter(ends >= begins).withColumn(b, F.explode(F.sequence(begins, ends)))
    holds = (F.coalesce(signal["from_us"], at) <= at) & (at < F.coalesce(signal["to_us"], at + 1))
    forward, backward = digits(F.coalesce(sent_bytes, F.unhex(F.lit(""))))
    keyed = frames.withColumns({b: F.floor(at / bucket), ahead: forward, back: backward})
    found = keyed.withColumnRenamed(b, f"{b}f").join(sent, (F.col(quoted(message)) == F.col(m)) & (F.col(f"{b}f") == F.col(b)) & holds, "left").drop(b, f"{b}f", m)
    found = found.join(known, F.col(quoted(message)) == F.col(m), "left").drop(m)
    [bits] = unused([*taken, e, own, ahead, back], "_bits")
    found = found.withColumn(bits, F.when(signal["place"].isNotNull(), field(F.col(ahead), F.col(back), signal["place"])))
    raw = F.col(bits)
    status = F.when(F.col(own).isNull(), "unknown_message").when(signal.isNull(), "no_version").when(signal["place"].isNull(), "bad_entry").when(raw.isNull(), "short_payload").otherwise("ok")
    value = raw.cast("double") * signal["factor"] + signal["offset"]
    new = {"signal": signal["signal"], "version": signal["version"], "unit": signal["unit"], "raw": raw, "value": value, "status": status}
    kept = [F.col(quoted(c)) for c in taken if c.lower() not in new]
    return found.select(*kept, *(c.alias(name) for name, c in new.items()))


def dictionary_check(decoded: DataFrame, dictionary: DataFrame, by: list[str]) -> DataFrame:
    """Signals of the dictionary, with how often they were decoded by ``by`` and status; entries
    never met count 0. The check of a dictionary against the result and its source."""
    counts = decoded.filter(F.col("signal").isNotNull()).groupBy(*by, "signal", "version", "status").agg(F.count(F.lit(1)).alias("n"))
    listed = dictionary.select("signal", "version").distinct()
    met = listed.join(counts, ["signal", "version"], "left")
    return met.select(*by, "signal", "version", F.coalesce("status", F.lit("never_met")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def coverage(dictionary: DataFrame) -> DataFrame:
    """Pairs of versions of one (message, signal) whose spans overlap: a dictionary should have none."""
    keys = ["message", "signal"]
    a = dictionary.select(*keys, F.col("version").alias("version"), F.col("from_us").alias("f1"), F.col("to_us").alias("t1"))
    b = dictionary.select(*keys, F.col("version").alias("other"), F.col("from_us").alias("f2"), F.col("to_us").alias("t2"))
    open_ = lambda c, n: F.coalesce(F.col(c), F.lit(n))
    least, most = -(1 << 62), 1 << 62
    meet = reduce(lambda x, y: x & y, (open_("f1", least) < open_("t2", most), open_("f2", least) < open_("t1", most), F.col("version") < F.col("other")))
    return a.join(b, keys).filter(meet).select(*keys, "version", "other")
