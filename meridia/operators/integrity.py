"""Manifests, digests, reconciliation and rule scans.

Null texts violate no rule and have null digests; null keys match nothing in comparisons and
are one-sided there; empty tables give empty results (one row where a summary is asked for).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Key, SHA-256 of the content and its bytes; null content stays null."""
    raw = F.col(content).cast("binary")
    return rows.select(key, F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"))


#: Control characters that JSON writers escape by number with a letter among its digits.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def canonical_json(value: Column) -> Column:
    """Compact JSON of a map, in which numbers of escaped control characters are lower case, as
    canonical texts have them and Spark's writer has not."""
    text = F.to_json(value)
    lower = text
    for digits in _LETTERED:  # after an even number of backslashes: others are escaped ones themselves
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(text.contains("\\u00"), lower).otherwise(text)


def canonical_digest(entries: DataFrame, by: list[str], path: str, value: str) -> DataFrame:
    """SHA-256 of each manifest's entries as compact JSON with sorted keys. A manifest is
    one group and is held as a whole, as the digest of its sorted text demands."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("k"), F.col(value).alias("v"))))
    text = canonical_json(F.map_from_entries(listed))
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.sha2(text, 256).alias("digest"))


def whole_digest(entries: DataFrame, path: str, value: str, size: int = 4096) -> DataFrame:
    """One row (entries, digest): SHA-256 of all entries as compact JSON with sorted keys, at
    any size. Entries are sorted over the cluster and joined to texts of ``size`` entries;
    SHA-256 takes its input in order, so one task reads these texts and holds one batch at a
    time. A path that repeats is an error, as keys of one object can't."""
    one = canonical_json(F.create_map(F.col(path), F.col(value)))
    listed = entries.select(F.col(path).alias("k"), F.substring(one, F.lit(2), F.length(one) - 2).alias("e")).orderBy("k")

    def join(batches):
        part, place, held, last = TaskContext.get().partitionId(), 0, [], None
        for rows in batches:
            for k, e in zip(rows["k"], rows["e"], strict=True):
                if k == last:
                    raise ValueError(f"path repeats in the manifest: {k}")
                last = k
                held.append(e)
                if len(held) == size:
                    yield pd.DataFrame({"part": [part], "place": [place], "n": [size], "text": [",".join(held)]})
                    place, held = place + 1, []
        if held:
            yield pd.DataFrame({"part": [part], "place": [place], "n": [len(held)], "text": [",".join(held)]})

    def fold(batches):
        total, digest = 0, hashlib.sha256(b"{")
        for rows in batches:
            for n, text in zip(rows["n"], rows["text"], strict=True):
                if n:
                    digest.update(("," if total else "").encode() + text.encode())
                    total += int(n)
        digest.update(b"}")
        yield pd.DataFrame({"entries": [total], "digest": [digest.hexdigest()]})

    shape = "part int, place int, n long, text string"
    texts = listed.mapInPandas(join, shape)
    start = entries.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("n"), F.lit("").alias("text"))
    return start.unionByName(texts).repartition(1).sortWithinPartitions("part", "place").mapInPandas(fold, "entries long, digest string")


def reconcile(actual: DataFrame, manifest: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer comparison: match, changed, missing (only in the manifest), extra."""
    a = actual.select(key, F.struct(*values).alias("_a"))
    m = manifest.select(key, F.struct(*values).alias("_m"))
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(f"_a.{v}").eqNullSafe(F.col(f"_m.{v}"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "extra").when(same, "match").otherwise("changed")
    return a.join(m, key, "full").select(key, status.alias("status"))


def subset_violations(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Expected entries that the actual set lacks or holds with another value."""
    a = actual.select(key, F.col(value).alias("found"))
    joined = expected.select(key, F.col(value).alias("expected")).join(a, key, "left")
    reason = F.when(F.col("found").isNull(), "absent").otherwise("differs")
    return joined.filter(~F.col("found").eqNullSafe(F.col("expected"))).select(key, reason.alias("reason"))


def equality(actual: DataFrame, manifest: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: entries of both sides, how many are changed, missing and extra, and whether
    both are equal, in number too (an entry that repeats on one side breaks that)."""
    found = reconcile(actual, manifest, key, values)
    count = lambda what: F.count_if(F.col("status") == what).alias(what)
    sums = found.agg(count("changed"), count("missing"), count("extra"))
    sizes = actual.agg(F.count(F.lit(1)).alias("entries")).crossJoin(manifest.agg(F.count(F.lit(1)).alias("listed")))  # one row each
    equal = (F.col("entries") == F.col("listed")) & (F.col("changed") + F.col("missing") + F.col("extra") == 0)
    return sizes.crossJoin(sums).select("entries", "listed", "changed", "missing", "extra", equal.alias("equal"))


def case_fold(name: Column) -> Column:
    """Caseless form by Unicode's full case folding, which Spark's functions lack: one letter may
    unfold to several, as in sharp s."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.str.casefold()

    return fold(name)


def case_collisions(rows: DataFrame, name: str) -> DataFrame:
    """Folded names that several distinct names share. Distinct names alone are folded."""
    folded = rows.select(name).distinct().groupBy(case_fold(F.col(name)).alias("folded")).agg(F.count_distinct(name).alias("n"))
    return folded.filter("n > 1")


def strict_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null isn't. Keys of an object may repeat,
    and NaN and Infinity are numbers. Spark's own parsers stop after a value, and refuse
    repeated keys unless the session allows them, so the texts go to Python's in batches."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            try:
                json.loads(text)
            except (TypeError, ValueError, RecursionError):
                return False
            return True

        return texts.map(one).astype(bool)

    return check(text)


def _hits(text: str, rules: list[tuple]) -> Column:
    """Array of the violated rules of a text."""
    found = []
    for k, (name, rule, *needed) in enumerate(rules):
        hit = F.col(text).rlike(rule) if isinstance(rule, str) else rule
        for literal in needed:  # a plain search spares texts that lack it the pattern
            hit = F.col(text).contains(literal) & hit
        found.append(F.when(hit, F.struct(F.lit(k).cast("long").alias("place"), F.lit(name).alias("rule"))))
    return F.array_compact(F.array(*found))


def scan_rules(rows: DataFrame, key: str, text: str, rules: list[tuple]) -> DataFrame:
    """Every violated rule of every text, with the rule's place in the fixed order. A rule is
    (name, pattern or condition), and optionally a literal that each match contains. Rules
    are a constant array, so a text is read once and nothing is joined."""
    return rows.select(key, F.explode(_hits(text, rules)).alias("_h")).select(key, "_h.rule", "_h.place")


def scan_counts(rows: DataFrame, kind: str, text: str, rules: list[tuple]) -> DataFrame:
    """Files and violations of each kind, and 'failed' where there is any: one pass over the
    texts, counts combined on the map side."""
    errors = F.sum(F.coalesce(F.size(_hits(text, rules)), F.lit(0))).cast("long")
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("files"), errors.alias("errors"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("passed"))


def disallowed_tokens(rows: DataFrame, key: str, text: str, pattern: str, allowed: DataFrame, group: int = 1) -> DataFrame:
    """All matches of a pattern that aren't in the allowed list, which Spark broadcasts if it is
    small enough."""
    found = rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("token"))
    return found.join(allowed, "token", "left_anti")


def path_verdict(path: Column, parts: list[str], suffixes: list[str]) -> Column:
    """First failed shape rule of a path, or 'ok'. The suffix of a name is what begins with its last
    point, if that is neither its first nor its last sign: a dotfile has none."""
    pieces = F.split(path, "/")
    name = F.regexp_extract(path, r"([^/]*)(?:/\.?)*$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return (
        F.when(path.startswith("/"), "absolute")
        .when(F.array_contains(pieces, ".."), "parent")
        .when(path.contains("\\"), "backslash")
        .when(path.contains(":"), "colon")
        .when(F.arrays_overlap(pieces, F.array(*map(F.lit, parts))), "part")
        .when(suffix.isin(*suffixes), "suffix")
        .when(name.startswith(".env") & (name != ".env.example"), "environment")
        .otherwise("ok")
    )


def syntax_valid(source: Column) -> Column:
    """Whether a text parses as Python; null stays null."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        import ast
        import warnings

        def one(text):
            if text is None:
                return None
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        return texts.map(one)

    return check(source)
