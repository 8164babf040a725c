"""Ignore rules against those of git itself, on random trees and rules."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from meridia.functions.ignore import ignored, selected

NAMES = ["a", "b", "build", "x.txt", "y.log", "a.b", "log", ".env", "a b", "[x]", "z!"]
PARTS = ["*", "a", "b", "build", "*.txt", "*.log", "?", "a*", "**", "[ab]", "[!a]", "[a-c]*", "log", "*.*", ".e*", "a b", "\\[x\\]", "[x"]


def pattern(draw):
    body = "/".join(draw.choice(PARTS) for _ in range(draw.choice([1, 1, 2, 3]))).replace("[x/", "x/")
    return draw.choice(["", "", "!"]) + draw.choice(["", "", "/"]) + body + draw.choice(["", "", "/", "  "])


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not here")
@pytest.mark.parametrize("seed", range(6))
def test_rules_are_those_of_git(spark, tmp_path, seed):
    draw = random.Random(seed)
    paths = sorted({"/".join(draw.choice(NAMES) for _ in range(draw.randint(1, 4))) for _ in range(250)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]  # a file is no folder
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").cache()
    for _ in range(4):
        rules = [pattern(draw) for _ in range(draw.randint(1, 6))] + ["# note", ""]
        (tmp_path / ".gitignore").write_text("\n".join(rules) + "\n")
        for p in paths:
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).touch()
        found = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=", "ls-files", "-z", "--others", "--exclude-per-directory=.gitignore"], capture_output=True, check=True).stdout
        kept = {p.decode() for p in found.split(b"\0") if p} - {".gitignore"}
        got = {r["path"] for r in selected(rows, "path", rules).collect()}
        assert got == kept, rules


def test_rules_by_hand(spark):
    rows = spark.createDataFrame([(p,) for p in ["", None, "a/b", "a/keep/b", "keep/a", "d/.git/x", "q/__pycache__/z.pyc", "test-results", "test-results/a"]], "path string")
    told = lambda *rules: {r["path"]: r["i"] for r in rows.select("path", ignored(F.col("path"), list(rules)).alias("i")).collect()}
    assert told()["a/b"] is False and told()[None] is None
    got = told("a/*", "!a/keep/")
    assert (got["a/b"], got["a/keep/b"], got["keep/a"]) == (True, False, False)
    got = told("a/", "!a/b")
    assert got["a/b"] and not got["keep/a"]  # nothing below an ignored folder comes back
    got = told(".git/", "__pycache__/", "test-results/")
    assert (got["d/.git/x"], got["q/__pycache__/z.pyc"], got["test-results"], got["test-results/a"]) == (True, True, False, True)
    assert selected(rows, "path", ["*"]).collect() == [("",), (None,)]
    one = spark.createDataFrame([("é",), ("ab",)], "path string")
    assert selected(one, "path", ["?"]).collect() == [("ab",)] and selected(one, "path", ["[^a]"]).collect() == [("ab",)]
