import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import mixing
from tests.llm.helpers import empty, hard, hard_rows


def expected_targets(sizes):
    """The contract's own loop: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if w else {}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def check_mix(docs, near):
    rows = mixing.mix_counts(docs).collect()
    words = sorted(((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == words
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    want = expected_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - target[s]) <= near, s
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_counts(docs).collect()))
    return rows


def test_mix_documents_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = check_mix(docs.select("doc_id", "text", "source"), 40)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_mix_hard_rows(spark):
    rows = mixing.mix_counts(hard(spark)).collect()
    assert len(rows) == len(hard_rows())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_counts(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0
    mixed = mixing.mix_documents(hard(spark))
    assert mixed.columns == hard(spark).columns
    assert all((r["score"], r["size"], r["_n"]) == (0.5, "clash", 7) for r in mixed.collect()) and mixed.count() > 0


def test_mix_hot_size_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 20)
    rows = [(k, "a b c", "big") for k in range(400)] + [(1000 + k, "x " * (k % 9), None) for k in range(60)] + [(5000, "y z", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_mix(docs, 3)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixing.mix_documents(docs).groupBy("doc_id").count().collect()} == got


def test_subset_counts_reaches_the_best_total():
    r = np.random.default_rng(7)
    for _ in range(60):
        sizes = np.unique(r.integers(1, 30, r.integers(1, 6)))
        counts = r.integers(0, 4, len(sizes))
        budget = int(r.integers(0, 90))
        take, best = mixing.subset_counts(sizes, counts, budget)
        totals = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            totals = {t + k * s for t in totals for k in range(c + 1)}
        assert best == max(t for t in totals if t <= budget)
        goal = budget // 2
        near, got = mixing.subset_counts(sizes, counts, budget, goal)
        assert abs(got - goal) == min(abs(t - goal) for t in totals if t <= budget) and int((near * sizes).sum()) == got
        assert (take <= counts).all() and int((take * sizes).sum()) == best


def fitted(cells, target):
    sizes, counts = (np.array(v, np.int64) for v in zip(*sorted(cells), strict=True))
    passes, take = mixing.fit_budget(sizes, counts, target)
    copies = passes * counts + take
    assert (copies >= 0).all() and (copies <= mixing.MAX_COPIES * counts).all()
    return int((copies * sizes).sum()), dict(zip(sizes.tolist(), copies.tolist(), strict=True))


def test_fit_budget_decides_long_sizes_exactly():
    assert fitted([(100, 600), (100_000, 1)], 120_000) == (120_000, {100: 200, 100_000: 1})
    assert fitted([(100_000, 1), (60_000, 1), (50_000, 1)], 110_000)[0] == 110_000
    assert fitted([(100, 300), (15_000, 2), (20_000, 1)], 48_000)[0] == 48_000
    assert fitted([(100_000, 1), (60_000, 1)], 180_000) == (180_000, {100_000: 0, 60_000: 3})
    assert fitted([(10_007, 40_000), (20_014, 9)], 3 * 10_007 + 4_000)[0] == 3 * 10_007


def test_fit_budget_is_nearest_of_all_totals():
    r = np.random.default_rng(11)
    for _ in range(150):
        sizes = np.unique(r.integers(1, r.choice([40, 30_000]), r.integers(1, 5)))
        counts = r.integers(1, 4, len(sizes))
        totals = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            totals = {t + k * s for t in totals for k in range(3 * c + 1)}
        want = int(r.integers(0, 3 * int((sizes * counts).sum()) + 1))
        got = fitted(list(zip(sizes.tolist(), counts.tolist(), strict=True)), want)[0]
        assert abs(got - want) == min(abs(t - want) for t in totals)


def test_mix_source_with_one_document_of_over_half_its_words(spark):
    # targets 120,000 and 240,000 of 360,000 words
    rows = [(k, "w " * 100, "a") for k in range(600)] + [(1000, "w " * 100_000, "a")]
    rows += [(2000, "v " * 100_000, "b"), (2001, "v " * 60_000, "b"), (2002, "v " * 40_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["copies"] for r in check_mix(docs, 0) if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixing.mix_documents(docs).groupBy("doc_id").count().collect()} == got


def test_mix_documents_meets_its_target_on_ties(spark):
    rows = [(7, "a b c d e f g h i j", "a", k) for k in range(40)] + [(8, "k l m n o p q r s t", None, 100 + k) for k in range(30)]
    rows += [(9, "a b c d e f g h i j", "b", 200 + k // 2) for k in range(30)] + [(300 + k, "x y " * (k % 4), "b", 300 + k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(6).cache()
    taken = {r["source"]: r["w"] for r in mixing.mix_counts(docs).groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    mixed = mixing.mix_documents(docs)
    got = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    assert got == taken and mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.filter("extra < 200").groupBy("extra").count().collect()) <= mixing.MAX_COPIES
    assert sorted(map(tuple, mixing.mix_documents(docs).collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr)
    docs.unpersist()


OWN = "__size _size __h _h __src _src __s _s _s1 _z1 _base _any _stop _copy _near_key _near_n _key _key2 _order _n ___id __id _id _digest _keep _group _row".split()


@pytest.mark.parametrize("operator", ["mix", "near", "exact"])
def test_columns_of_the_caller_stay(spark, operator):
    from meridia.llm import exact_dedup, near_dedup

    texts = ["one two three four five six", "one two three four five six", "another text of some words", None, None, "x"]
    rows = [(k // 2 or None, t, ["a", None][k % 2], *range(len(OWN))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in OWN)).repartition(2)
    out = {"mix": mixing.mix_documents, "near": near_dedup.drop_near_duplicates, "exact": exact_dedup.drop_duplicates}[operator](docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r[c] for c in OWN) == tuple(range(len(OWN))) for r in got)
