"""Operators on null keys and times, repeated rows, and tables that hold the operators' own names."""

import glob
import hashlib
import json
import os
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from meridia.operators import asof, history, integrity, measures, records

FOLDER = os.path.dirname(history.__file__)
OWN = sorted({m for f in glob.glob(f"{FOLDER}/*.py") for m in re.findall(r'"(_[a-z][a-z_]*)"', open(f).read())} | {f"_{x}{k}" for x in ("by", "k", "lo", "hi") for k in range(2)})

ROWS = [(k, "u" if k % 3 else None, None if k % 5 == 0 else 1000 * (k // 2), "s" + str(k // 4 % 2), float(k % 7)) for k in range(40)]
ROWS += ROWS[:3]


def plain(spark):
    return spark.createDataFrame(ROWS, "id long, u string, t long, s string, v double")


def clashing(spark):
    return plain(spark).select("*", *(F.lit(k).alias(c) for k, c in enumerate(OWN)))


def attempts(rows):
    return records.pick_attempt(rows, ["u"], ["id", "t"], F.col("v") > 5, F.col("v") > 100)


def artifacts(rows):
    return rows.withColumns({"sha256": F.col("s"), "bytes": F.col("id")})


def receipts(rows):
    return artifacts(rows).withColumn("result", F.lit("confirmed"))


OPERATORS = {
    "gap": lambda r: measures.with_gap(r, ["u"], "t", "id"),
    "skips": lambda r: measures.skips(r, ["u"], "t", "id", 100),
    "rate": lambda r: measures.rate(r, ["u"], "t", 5000),
    "runs": lambda r: measures.runs(r, ["u"], "t", "id", "s"),
    "quantiles": lambda r: measures.quantiles(r, ["u", "s"], "v", {"p50": 0.5, "p90": 0.9}),
    "histogram": lambda r: measures.histogram(r, ["u"], "v", 2.0),
    "stages": lambda r: measures.stage_durations(r, ["u"], "s", "t", 100),
    "island": lambda r: history.with_island(r, ["u"], "t", "id", "s", "island"),
    "nearest": lambda r: asof.nearest_points(r, r.select("u", F.col("t").alias("pt"), F.col("id").alias("pe")), ["u"], "t", "pt", "pe", 2, 5000),
    "before": lambda r: history.with_row_before(r, ["u"], "t", "id", "s", "was"),
    "sum": lambda r: history.with_running_sum(r, ["u"], "t", "id", F.lit(1), "n"),
    "asof": lambda r: asof.asof_join(r, r.select("u", "t", "v"), ["u"], "t", ["v"], 10_000),
    "first": lambda r: records.first_by(r, ["u"], ["t", "id"]),
    "source": lambda r: records.choose_source(r.withColumns({"env": F.lit("primary"), "outcome": F.lit("ok")}), ["u"]),
    "pages": lambda r: records.complete_pages(r, ["u"], "id", "t"),
    "attempt": attempts,
    "fair": lambda r: records.fair_order(r, "u", "t", "id"),
    "admitted": lambda r: records.admitted(r, "u", "t", "id", 5),
    "binding": lambda r: records.binding(r, ["u"], "s"),
    "queue": lambda r: records.next_unfinished(r, "u", "id", F.col("v") > 3),
    "delivery": lambda r: records.delivery_status(artifacts(r), receipts(r), "id"),
    "transitions": lambda r: records.transitions(r, "u", "t", "id", "s", [("s0", "s1")]),
    "sorted": lambda r: records.sorted_in_tasks(r, ["u"], ["t", "id"]),
    "followup": lambda r: records.with_followup(r, r.withColumn("registered", F.col("v") > 3), "id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_of_the_operators_change_nothing(spark, name):
    want = OPERATORS[name](plain(spark))
    got = OPERATORS[name](clashing(spark))
    shared = want.columns
    assert set(shared) <= set(got.columns)
    ties = {"sorted", "fair", "admitted", "gap", "before", "sum"} & {name}  # repeated rows tie: their places may be exchanged
    assert sorted(map(repr, got.select(*shared).collect())) == sorted(map(repr, want.collect())) or (ties and got.count() == want.count())


def test_names_found():
    assert {"_before_us", "_new", "_d", "_k", "_r", "_ok", "_changes", "_way"} <= set(OWN)


def test_fair_order_keeps_tasks_without_a_time(spark):
    rows = [(k, "ab"[k % 2] if k % 7 else None, None if k % 3 == 0 else 100 * k) for k in range(50)]
    tasks = spark.createDataFrame(rows, "id long, u string, t long")
    out = records.fair_order(tasks, "u", "t", "id").collect()
    assert len(out) == 50 and sorted(r["position"] for r in out) == list(range(1, 51))
    early = lambda t: -1 if t is None else t
    rounds, want = {}, []
    for i, u, t in sorted(rows, key=lambda r: (early(r[2]), r[0])):
        rounds[u] = rounds.get(u, 0) + 1
        want.append((rounds[u], early(t), i))
    assert [r["id"] for r in sorted(out, key=lambda r: r["position"])] == [i for _, _, i in sorted(want)]


def test_digest_of_every_control_character(spark):
    entries = {f"a{chr(k)}b{k}": f"v{chr(k)}" for k in range(1, 128)} | {"x\\u001F": "y\\\\u000B", "\\\u001f\\\\\u000b": "\u001a\u001b", "é中\U0001f600": "ß"}
    rows = spark.createDataFrame([(1, k, v) for k, v in entries.items()], "m int, path string, value string")
    text = json.dumps(dict(sorted(entries.items())), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    want = hashlib.sha256(text.encode()).hexdigest()
    assert integrity.canonical_digest(rows, ["m"], "path", "value").first()["digest"] == want
    assert integrity.whole_digest(rows, "path", "value", 7).first()["digest"] == want


def test_suffixes_are_those_of_pure_paths(spark):
    names = [".pem", "x/.key", "x/.zip", "a.pem", "a.b.PEM", "a.pem.", "a.", "..pem", ".a.pem", "a.pem/", "a.pem/.", "pem", "x.pem/y", ".", "", "a/.env", "a/.env.example", "a/.envrc/"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: r["v"] for r in rows.select("path", integrity.path_verdict(F.col("path"), ["no"], [".pem", ".key", ".zip"]).alias("v")).collect()}
    for n in names:
        p = PurePosixPath(n)
        want = "suffix" if p.suffix.lower() in (".pem", ".key", ".zip") else "environment" if p.name.startswith(".env") and p.name != ".env.example" else "ok"
        assert got[n] == want, n


def test_strict_json_is_that_of_the_parser(spark):
    texts = ['{"a":1,"a":2}', "[1,]", "1 2", "", " ", "NaN", "[Infinity, -Infinity]", '{"a":{"b":[]}}', "{'a':1}", '"x', "null", "01", '"\\ud800"', '{"a":1}x', None, "[" * 5000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["ok"] for r in rows.select("k", integrity.strict_json(F.col("t")).alias("ok")).collect()}
    for k, t in enumerate(texts):
        try:
            json.loads(t)
            want = True
        except (TypeError, ValueError, RecursionError):
            want = False
        assert got[k] == want, t


def test_a_hot_job_is_many_tasks(spark, tmp_path):
    rows = [(None if k % 11 == 0 else ("hot" if k % 3 else f"j{k % 40}"), None if k % 17 == 0 else 7919 * k % 10_007, k) for k in range(6000)]
    table = spark.createDataFrame(rows, "job string, t long, id long").repartition(5).withColumn("place", F.lit("theirs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    out = records.sorted_in_tasks(table, ["job"], ["t", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["id"]: r["place"] for r in out.collect()}
    groups = {}
    for job, t, i in rows:
        groups.setdefault(job, []).append((-1 if t is None else t, i))
    want = {i: k for g in groups.values() for k, (_, i) in enumerate(sorted(g), 1)}
    assert got == want
    written = spark.read.parquet(os.path.dirname(out.inputFiles()[0]))
    assert written.filter("job = 'hot'").select("_part").distinct().count() > 1
    assert records.sorted_in_tasks(table.limit(0), ["job"], ["t"]).count() == 0


def test_sketches_tell_exact_ranks_to_their_bound(spark):
    import math
    import random

    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(12), int(draw.choice([1, -1]) * math.exp(draw.uniform(0, 43)))) for _ in range(4000)]
    rows += [("a", 3, 0), ("a", 3, None), ("a", None, 5), ("b", 30, (1 << 62) + 12345), ("c", 2, -7)]
    table = spark.createDataFrame(rows, "k string, t long, v long")
    first, later = table.filter("v % 2 = 0 OR v IS NULL"), table.filter("v % 2 <> 0")
    sketches = measures.day_sketches(first, ["k"], "t", "v", 1).unionByName(measures.day_sketches(later, ["k"], "t", "v", 1))  # merged from two parts
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {(r["k"], r["span"]): r for r in measures.rolling_quantiles(sketches, ["k"], 4, wanted).collect()}
    assert set(got) == {(k, t) for k, t, v in rows if t is not None and v is not None}
    for (k, t), r in got.items():
        values = sorted(v for a, b, v in rows if a == k and b is not None and t - 3 <= b <= t and v is not None)
        assert r["n"] == len(values)
        for name, q in wanted.items():
            exact = values[math.floor(q * (len(values) - 1))]
            assert abs(exact) - abs(exact) / 128 <= abs(r[name]) <= abs(exact) and exact * r[name] >= 0
    values = list(range(-300, 1000)) + [(1 << k) + d for k in range(10, 62) for d in (-1, 0, 1)]
    bins = spark.createDataFrame([(v,) for v in values], "v long").select("v", measures.sketch_bin(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x["b"] <= y["b"] for x, y in zip(bins, bins[1:], strict=False))


def test_delivery_is_bound_to_receiver_and_source(spark):
    kind = "id long, sha256 string, bytes long, receiver string, source string"
    sent = spark.createDataFrame([(k, "h", 1, "r", None if k == 3 else "s") for k in range(4)], kind)
    back = spark.createDataFrame([(0, "h", 1, "r", "s", "confirmed"), (1, "h", 1, "other", "s", "confirmed"), (2, "h", 1, "r", None, "confirmed"), (3, "h", 1, "r", None, "confirmed")], kind + ", result string")
    told = lambda *bound: {r["id"]: r["status"] for r in records.delivery_status(sent, back, "id", bound).collect()}
    assert told("receiver", "source") == {0: "sent", 1: "unproven", 2: "unproven", 3: "sent"}
    assert set(told().values()) == {"sent"}


def test_resume_needs_the_recorded_bindings(spark):
    branches = spark.createDataFrame([(k, b, b == "log") for k in range(5) for b in ("log", "signal")], "id long, branch string, ok boolean")
    none = spark.createDataFrame([], "id long")
    recorded = spark.createDataFrame([(0, "a", "b"), (1, "a", "b"), (2, None, "b"), (3, "a", "b")], "id long, request string, source string")
    seen = spark.createDataFrame([("b", 0, "a"), ("x", 1, "a"), ("b", 2, None), ("b", 4, "a")], "source string, id long, request string")
    plan = records.recovery_plan(branches, "id", "branch", F.col("ok"), none, none, recorded, seen)
    assert sorted(r["id"] for r in plan.collect()) == [0, 2]
    assert records.recovery_plan(branches, "id", "branch", F.col("ok"), none, none).count() == 5
