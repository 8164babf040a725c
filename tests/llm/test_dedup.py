import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.llm import exact_dedup, near_dedup
from tests.llm.helpers import SCHEMA, empty, hard, hard_rows


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    keep = {d: min((x for x in g if x is not None), default=None) for d, g in groups.items()}
    return sorted(((i, keep[digest(t)], len(groups[digest(t)]), digest(t)) for i, t in rows), key=repr)


def test_exact_hard_rows(spark):
    out = exact_dedup.mark_duplicates(hard(spark)).collect()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr)
    assert got == exact_expected([(r[0], r[1]) for r in hard_rows()])
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in out})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def test_exact_heavy_groups_take_the_broadcast_path(spark):
    rows = [(k, "hot text" if k % 3 else f"text {k}") for k in range(900)] + [(2000 + k, "warm") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    digests = docs.select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_row"), exact_dedup.text_digest(docs["text"]).alias("_digest"))
    assert {r["_size"] for r in exact_dedup.heavy_winners(digests).collect()} == {600, 80}
    out = exact_dedup.mark_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == sorted(exact_expected(rows))
    left = exact_dedup.drop_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(r["doc_id"] for r in out if r["kept"])


def test_exact_drop_keeps_columns_and_one_of_each(spark):
    left = exact_dedup.drop_duplicates(hard(spark))
    assert left.columns == hard(spark).columns
    texts = [digest(r["text"]) for r in left.collect()]
    assert sorted(texts) == sorted({digest(r[1]) for r in hard_rows()})
    assert all((r["score"], r["size"], r["_n"]) == (0.5, "clash", 7) for r in left.collect())
    assert exact_dedup.drop_duplicates(empty(spark)).count() == 0


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def near_expected(rows, k):
    """Union-find over all pairs, on whole sets of word tuples."""
    all_sets = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = all_sets[i], all_sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(all_sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check_near(spark, rows, k, docs=None):
    docs = docs or spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = near_dedup.mark_near_duplicates(docs, words=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr) == near_expected(rows, k)
    return out


def test_near_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    for k in (2, 5):
        check_near(spark, rows, k, hard(spark))
    assert near_dedup.mark_near_duplicates(empty(spark)).count() == 0
    left = near_dedup.drop_near_duplicates(hard(spark), words=2)
    assert left.columns == hard(spark).columns
    assert all((r["score"], r["digest"], r["_n"]) == (0.5, "clash", 7) for r in left.collect())
    assert left.count() == sum(r["kept"] for r in near_dedup.mark_near_duplicates(hard(spark), words=2).collect())
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("large", "block", "dense"), [(3, 4, 8), (3, 512, 1), (10**6, 4, 8), (3, 512, 14)])
def test_near_chains_borders_and_groups(spark, monkeypatch, large, block, dense):
    import random

    for name, value in (("LARGE", large), ("BLOCK", block), ("DENSE", dense), ("MASS", 60 if dense == 14 else 10**6)):
        monkeypatch.setattr(near_dedup, name, value)

    r = random.Random(5)
    rows = []
    for g in range(12):
        text = [f"g{g}x{r.randrange(900)}" for _ in range(r.choice([3, 6, 12, 40, 120]))]
        for _ in range(r.choice([2, 5, 30])):  # drifting copies: chains whose ends are not alike
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = f"n{r.randrange(10**6)}"
    check_near(spark, rows, 2)
    if large == 3:
        check_near(spark, rows, 5)


def test_near_of_rows_that_repeat(spark):
    """Many rows without an id and of one text beside copies of it."""
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text)] * 60 + [(k, text.replace("w5 ", f"v{k} ")) for k in range(5)] + [(9, text)] * 3
    out = check_near(spark, rows, 2)
    assert sum(r["kept"] for r in out) == 1
    assert near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=2).count() == 1


def test_near_drop_returns_what_mark_keeps(spark):
    """Rows that repeat with and without words, ids and texts."""
    rows = [(6, ""), (6, ""), (None, None), (None, None), (None, " "), (7, "one two three"), (7, "one two three"), (8, "One two THREE"), (None, "four"), (None, "four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = near_dedup.mark_near_duplicates(docs, words=2).filter("kept").collect()
    left = near_dedup.drop_near_duplicates(docs, words=2).collect()
    assert sorted(repr(r["doc_id"]) for r in marked) == sorted(repr(r["doc_id"]) for r in left) and len(left) == 7


def test_near_large_group_at_the_defaults(spark):
    """A bucket well over LARGE with several components, and a small one, at production values."""
    import random

    r = random.Random(9)
    rows = []
    for g, many in enumerate((150, 6)):
        base = [f"g{g}x{k}" for k in range(60)]
        for k in range(many):
            text = list(base)
            for _ in range(r.choice([1, 4, 7])):
                text[r.randrange(60)] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    assert near_dedup.LARGE < 150
    check_near(spark, rows, 2)


def test_signatures_recall_at_the_border():
    """Pairs of similarity 0.80 to 0.82 share a key and stay within FAR, on short sets too."""
    import numpy as np

    nd, rng, met, far, total = near_dedup, np.random.default_rng(3), 0, 0, 0
    for size in (9, 10, 40, 300):
        for _ in range(500):
            both = int(np.ceil(0.8 * size))  # of `size` in the union
            union = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
            cut = both + (size - both) // 2
            a, b = (nd.signature(np.sort(x)) for x in (np.concatenate([union[:both], union[both:cut]]), np.concatenate([union[:both], union[cut:]])))
            same = a == b
            chunks = same[: nd.SYMBOLS].reshape(nd.CHUNKS, nd.WIDTH).sum(axis=1)
            met += bool((chunks >= nd.WIDTH - nd.ERRORS).any())
            far += int((~same).sum()) > nd.FAR
            total += 1
    assert met == total and far == 0


def test_near_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check_near(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 2, docs)


def test_components(spark):
    import random

    r = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x["node"]: x["comp"] for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert SCHEMA


def test_blocks_go_on_across_batches():
    import numpy as np
    import pyarrow as pa

    from meridia.llm import near_dedup as nd

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, nd.TOTAL).astype("<u2")
    rows = []
    for key, size in enumerate([1, 7, 2, 40, 1, 25]):
        for _ in range(size):
            sig = base.copy()
            sig[rng.integers(0, nd.TOTAL, rng.integers(0, 70))] ^= np.uint16(1)
            rows.append((key, key % 3, 0, 0, len(rows), int(rng.integers(0, 5)), int(rng.integers(70, 100)), sig))
    want = set()
    for x in rows:
        for y in rows:
            same = x[7] == y[7]
            if x[0] == y[0] and x[4] < y[4] and x[5] != y[5] and 100 * min(x[6], y[6]) >= 80 * max(x[6], y[6]) and nd.TOTAL - same.sum() <= nd.FAR and nd._first_slot(same[None, : nd.SYMBOLS])[0] == x[1]:
                want.add((x[4], y[4]))
    names, kinds = ("key", "slot", "i", "j", "node", "comp", "n", "sig"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = [pa.array([r[k].tobytes() if k == 7 else r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    whole = pa.RecordBatch.from_arrays([*cols, pa.array([0] * len(rows), pa.int32())], [*names, "part"])
    for size in (1, 3, 10, len(rows)):
        got = [p for b in nd._near_in_blocks((whole.slice(k, size) for k in range(0, len(rows), size)), 80) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert list(nd._near_in_blocks(iter([whole.slice(0, 0)]), 80)) == []


def test_near_query_keeps_by_id(spark, tmp_path):
    from meridia.llm.queries import op6_minhash_near_dedup

    text = " ".join(f"w{k}" for k in range(30))
    spark.createDataFrame([(0, text), (0, text), (3, text), (None, None), (4, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in op6_minhash_near_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(0, 0, True), (0, 0, True), (3, 0, False), (None, None, True), (4, 4, True)], key=repr)
