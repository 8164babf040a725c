"""The data sources: copies that are all or nothing, and point logs in any split."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from meridia.sources import pointlog
from meridia.sources.copyout import CopyOut
from meridia.sources.pointlog_source import PointLog

FILES = "path string, content binary, sha256 string, bytes long"


def entries(spark, contents, change=None):
    rows = [(p, bytearray(c), hashlib.sha256(c).hexdigest(), len(c)) for p, c in contents]
    for k, column, value in change or []:
        rows[k] = tuple(value if i == FILES.split(", ").index(next(f for f in FILES.split(", ") if f.startswith(column))) else v for i, v in enumerate(rows[k]))
    return spark.createDataFrame(rows, FILES).repartition(4)


def tree(path):
    return {os.path.relpath(f, path): open(f, "rb").read() for f in glob.glob(f"{path}/**", recursive=True, include_hidden=True) if os.path.isfile(f)}


CONTENTS = [(f"d{k % 5}/e{k % 3}/f{k}.txt", os.urandom(k * 37)) for k in range(60)] + [("top.txt", b""), (".hidden", b"x"), ("a.deadbeef", b"named so")]


def test_copy_is_whole(spark, tmp_path):
    spark.dataSource.register(CopyOut)
    entries(spark, CONTENTS).write.format("copyout").mode("append").save(f"{tmp_path}/out")
    assert tree(f"{tmp_path}/out") == dict(CONTENTS)
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="target exists"):
        entries(spark, CONTENTS).write.format("copyout").mode("append").save(f"{tmp_path}/out")
    assert tree(f"{tmp_path}/out") == dict(CONTENTS)
    entries(spark, CONTENTS).limit(0).write.format("copyout").mode("append").save(f"file://{tmp_path}/none")
    assert tree(f"{tmp_path}/none") == {} and sorted(os.listdir(tmp_path)) == ["none", "out"]


@pytest.mark.parametrize(
    "change",
    [[(7, "sha256", "0" * 64)], [(9, "bytes", 1)], [(3, "content", None)], [(3, "sha256", None)], [(5, "path", "../x")], [(5, "path", "/x")], [(5, "path", "a//b")], [(5, "path", None)], [(5, "path", CONTENTS[6][0])], [(5, "path", "a\\b")]],
    ids=lambda c: f"{c[0][1]}={str(c[0][2])[:6]}",
)
def test_one_bad_file_leaves_nothing(spark, tmp_path, change):
    spark.dataSource.register(CopyOut)
    with pytest.raises(Exception, match="refused|repeats"):
        entries(spark, CONTENTS, change).write.format("copyout").mode("append").save(f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_task_that_dies_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(CopyOut)
    boom = F.when(F.col("path") == CONTENTS[30][0], F.raise_error(F.lit("died"))).otherwise(F.col("path"))
    with pytest.raises(Exception, match="died"):
        entries(spark, CONTENTS).withColumn("path", boom).write.format("copyout").mode("append").save(f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def lines(seed, n):
    draw = random.Random(seed)
    odd = ["", "  ", "# note", "v s 12", "v s x 1.0", "v s 5 1_0", "v s 99999999999999999999 1", "v s 5 abc", "\tv  s\t-7 1e3 ", "v s 5 NaN", "v s 6 .5", "v s 7 é", "v s 8 2.", "x" * 3000, "v s 9 1d", "v s 4 --1"]
    return [draw.choice(odd) if draw.random() < 0.4 else f"car{draw.randrange(9)} sig{draw.randrange(5)} {draw.randrange(10**12)} {draw.random():.6f}" for _ in range(n)]


@pytest.mark.parametrize("width", [7, 100, 5000, 1 << 25])
def test_any_split_gives_the_lines(spark, tmp_path, width):
    spark.dataSource.register(PointLog)
    for k in range(3):
        text = "\n".join(lines(k, 150)) + ("\n" if k else "")
        (tmp_path / f"{k}.log").write_text(text)
    (tmp_path / "empty.log").write_text("")
    got = spark.read.format("pointlog").option("path", str(tmp_path)).option("range_bytes", width if width > 50 else 400 + width).load()
    want = pointlog.read_points(spark, str(tmp_path))
    same = ["vehicle", "signal", "ts_us", "value", "ok", "line"]
    assert sorted(map(repr, got.select(*same).collect())) == sorted(map(repr, want.select(*same).collect()))
    assert got.select("file", "at").distinct().count() == got.count() and {r["ok"] for r in got.collect()} == {True, False}


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(PointLog)
    assert spark.read.format("pointlog").option("path", str(tmp_path)).load().count() == 0


def test_stream_follows_growing_files(spark, tmp_path):
    spark.dataSource.register(PointLog)
    os.makedirs(tmp_path / "in")
    whole = {k: ("\n".join(lines(k, 120)) + "\n").encode() for k in range(3)}
    cuts = {0: [500, 501, None], 1: [0, 3000, None], 2: [0, 0, None]}

    def run():
        stream = spark.readStream.format("pointlog").option("path", f"{tmp_path}/in").option("range_bytes", 700).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    for step in range(3):
        for k, data in whole.items():
            if cuts[k][step] != 0:
                (tmp_path / "in" / f"{k}.log").write_bytes(data[: cuts[k][step]])
        run()
    run()  # nothing new
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = spark.read.format("pointlog").option("path", f"{tmp_path}/in").load().collect()
    assert sorted(map(repr, (r.asDict() for r in got))) == sorted(map(repr, (r.asDict() for r in want)))
    (tmp_path / "in" / "1.log").write_bytes(b"short\n")
    with pytest.raises(Exception, match="shrank"):
        run()
