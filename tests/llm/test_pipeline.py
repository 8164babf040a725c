"""The pipeline against brute force on sf0.001, stage by stage."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from meridia.llm import quality
from tests.llm.helpers import empty, hard, hard_rows
from tests.llm.test_dedup import digest, near_expected
from tests.llm.test_mixing import expected_targets
from tests.llm.test_tokens import plain


def test_pipeline_stage_by_stage(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {"start": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = docs.collect()

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    taught = [(quality.statistics(r["text"]), labels[r["doc_id"]]) for r in kept["start"] if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x, y = np.array([t[0] for t in taught]), np.array([t[1] for t in taught], float)
    order = np.lexsort([*x.T, y])
    model = quality.fit(x[order], y[order])
    good = [r for r in kept["start"] if model.score(np.array([quality.statistics(r["text"])]))[0] >= 0.3]
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(r["doc_id"] for r in good)
    assert 0.5 < len(good) / len(kept["start"]) < 1

    first = {}
    for r in good:
        first[digest(r["text"])] = min(first.get(digest(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(first.values())

    near = near_expected([(r["doc_id"], r["text"]) for r in kept[1]], 5)
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(i for i, _, head in near if i == head or head is None)

    words = {r["doc_id"]: len(r["text"].encode().split()) for r in kept[2]}
    source = {r["doc_id"]: r["source"] for r in kept[2]}
    sizes, taken, times = {}, {}, {}
    for i, n in words.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    for r in kept[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + words[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    for s, target in expected_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(60, 0.05 * target)  # few documents a source here

    want = sorted(len(plain("word_bpe_49k.json", r["text"])) // 4 + 1 for r in kept[3])
    lengths, sequences = {}, {}
    for r in kept[4]:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in kept[4]) == sum(want)
    assert sum(r["piece"] == 0 for r in kept[4]) == len(kept[3])
    assert sorted(map(repr, corpus_pipeline.run(spark, data).select("doc_id", "piece", "ids_crc32").collect())) == sorted(repr(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect())
    assert not lengths


@pytest.mark.parametrize("rows", [hard, empty])
def test_pipeline_on_hard_rows(spark, tmp_path, rows):
    """Null ids, texts and sources, empty and long texts, ties, repeated rows, extra columns with
    the operators' own names, and an empty table."""
    docs = rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == (rows is hard)
    known = {(r[0], len(r[1] or "")) for r in hard_rows()}
    assert {r["doc_id"] for r in out} <= {i for i, _ in known}
    ends = {}
    for r in out:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 2048
