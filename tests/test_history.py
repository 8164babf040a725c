"""History operators on a key that holds most rows, against plain loops."""

import random

from pyspark.sql import functions as F

from meridia.operators import asof, history, measures, records


def test_rows_before_and_running_sums_cross_buckets(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(-40, 90)]), k, r.choice(["a", "b", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "u long, t long, e long, s string").repartition(5)
    before, count, seen = {}, {}, {}
    for u, t, e, s in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        past = seen.setdefault(u, [])
        before[e], count[e] = (past[-1] if past else None), sum(x == "a" for x in past) + (s == "a")
        past.append(s)
    for bucket, most in ((1, 100), (7, 100), (10**6, 100), (40, 5), (10**6, 1)):
        found = history.with_row_before(df, ["u"], "t", "e", "s", "before", bucket, most)
        found = history.with_running_sum(found, ["u"], "t", "e", F.coalesce(F.col("s") == "a", F.lit(False)).cast("int"), "n", bucket, most)
        assert found.columns == ["u", "t", "e", "s", "before", "n"]
        assert {x["e"]: (x["before"], x["n"]) for x in found.collect()} == {e: (before[e], count[e]) for e in before}


def test_a_hot_key_is_many_windows(spark):
    df = spark.range(2000).select(F.lit(1).alias("u"), F.col("id").alias("t"), F.col("id").alias("e"))
    plan = history.with_row_before(df, ["u"], "t", "e", "t", "before", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [lag(_p" in line and "_b#" in line.split("], [")[1]]


def test_crowded_buckets_are_cut_by_their_rows(spark):
    df = spark.range(1000).select(F.lit(1).alias("u"), F.col("id").alias("t"), F.lit(7).alias("_coarse"))
    parts = history.with_time_bucket(df, ["u"], "t", 500, 50, "b").groupBy("b", "_coarse").count().collect()
    assert len(parts) == 20 and {r["count"] for r in parts} == {50} and {r["_coarse"] for r in parts} == {7}


def test_islands_cross_buckets(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(-40, 90)]), k % 390, r.choice(["a", "a", "b", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "u long, t long, e long, s string").repartition(5)
    low = lambda x: (x is not None, x if x is not None else 0)
    want, last, number = [], {}, {}
    for u, t, e, s in sorted(rows, key=lambda x: (low(x[1]), x[2], (x[3] is not None, x[3] or ""))):
        number[u] = number.get(u, 0) + (u not in last or s is None or s != last[u])
        last[u] = s
        want.append((u, t, e, s, number[u]))
    for bucket, most in ((1, 100), (7, 100), (10**6, 100), (40, 5), (10**6, 1)):
        found = history.with_island(df, ["u"], "t", "e", "s", "island", bucket, most)
        assert found.columns == ["u", "t", "e", "s", "island"]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert history.with_island(df.limit(0), ["u"], "t", "e", "s", "island").count() == 0


def test_histories_are_bucketed_once(spark, tmp_path):
    spark.range(500).selectExpr("id % 3 AS u", "id AS t", "id AS e", "id % 2 AS s").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    scans = lambda x: x._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(measures.runs(df, ["u"], "t", "e", "s")) <= 4
    assert scans(records.fair_order(df, "u", "t", "e")) <= 4
    points = df.select("u", "s", F.col("t").alias("pt"), F.col("e").alias("pe"))
    assert scans(asof.nearest_points(df, points, ["u"], "t", "pt", "pe", 2, 9)) <= 4


def test_nearest_points_of_small_buckets(spark):
    r = random.Random(12)
    anchors = [(r.choice([1, 1, 1, 2, None]), k, r.choice([None, *range(-20, 40)])) for k in range(60)]
    points = [(r.choice([1, 1, 1, 2, 3, None]), k % 140, r.choice([None, *range(-20, 40)])) for k in range(150)]
    a, b = spark.createDataFrame(anchors, "u long, a long, at long"), spark.createDataFrame(points, "u long, p long, t long")
    want = []
    for u, k, at in anchors:
        near = [(abs(t - at), p, t < at) for w, p, t in points if w is not None and w == u and None not in (t, at) and abs(t - at) <= 6]
        for early in (True, False):
            want += [(k, p) for _, p, s in sorted(x for x in near if x[2] == early)[:3]]
    for bucket, most in ((1, 100), (5, 100), (10**6, 100), (10, 2)):
        found = asof.nearest_points(a, b, ["u"], "at", "t", "p", 3, 6, bucket, most)
        assert found.columns == ["u", "a", "at", "p", "t"]
        assert sorted((x["a"], x["p"]) for x in found.collect()) == sorted(want)
    assert asof.nearest_points(a.limit(0), b, ["u"], "at", "t", "p", 3, 6).count() == 0
    assert asof.nearest_points(a, b.limit(0), ["u"], "at", "t", "p", 3, 6).count() == 0


def test_a_round_of_many_tasks_is_many_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("u"), (F.col("id") * 7 % 3001).alias("t"), F.col("id").alias("e"), F.lit("theirs").alias("place"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = records.fair_order(df, "u", "t", "e")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {x["e"]: (x["round"], x["position"]) for x in out.collect()}
    written = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    assert written.filter("round = 1").select("_part").distinct().count() > 1
    rounds, tasks = {}, []
    for t, e, u in sorted((k * 7 % 3001, k, k if k % 50 else None) for k in range(3000)):
        rounds[u] = rounds.get(u, 0) + 1
        tasks.append((rounds[u], t, e))
    assert got == {e: (n, k) for k, (n, _, e) in enumerate(sorted(tasks), 1)} and out.first()["place"] == "theirs"
