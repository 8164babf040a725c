"""Whitening, sharding and collocations against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import collocations, queries, sharding, whitening
from meridia.llm.scratch import new_path
from tests.llm.helpers import SCHEMA, empty, hard, hard_rows

VECTORS = "vec_id long, embedding array<double>, n int, component string, _v int"


def table(spark, vectors, kind="double"):
    schema = VECTORS.replace("double", kind)
    return spark.createDataFrame([(k, v, 1, "clash", 2) for k, v in vectors], schema).repartition(3)


def exact(vectors):
    """(ids, x - S/n as doubles, covariance, deviations) by fractions."""
    kept = [(k, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for k, v in vectors]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    centred = [[Fraction(a * n - s, n) for a, s in zip(x, sums, strict=True)] for _, x in kept]
    d = len(sums)
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    return [k for k, _ in kept], np.array([[float(a) for a in c] for c in centred]), v, [int(sum((a * n) ** 2 for a in c)) for c in centred]


def check_whitening(rows, vectors, k):
    ids, centred, v, deviations = exact(vectors)
    values, axes = np.linalg.eigh(v)
    by = defaultdict(dict)
    for r in rows:
        by[r["vec_id"]][r["component"]] = r
    assert sorted(by) == sorted(ids) and len(rows) == len(ids) * k
    for j in range(1, k + 1):
        axis, value = axes[:, -j], values[-j]
        want = centred @ axis / np.sqrt(value)
        got = np.array([by[i][j]["whitened"] for i in ids])
        sign = np.sign((want * got).sum())
        assert np.allclose(got, sign * want, atol=1e-9)
        assert by[ids[0]][j]["explained"] == pytest.approx(value / np.trace(v), rel=1e-9)
    for i, dev in zip(ids, deviations, strict=True):
        assert all(int(r["deviation"]) == dev and r["n"] == len(ids) and r["identity_error"] < 1e-9 for r in by[i].values())


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_whitening_is_that_of_exact_fractions(spark, tile):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(90, 10)) @ rng.normal(size=(10, 10)) + 500 * rng.normal(size=10)
    vectors = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows = whitening.whiten(table(spark, vectors), tile=tile).collect()
    check_whitening(rows, vectors, 8)


def test_whitening_of_unlike_scales_and_large_entries(spark):
    rng = np.random.default_rng(6)
    scales = np.array([1e9, 1e5, 1.0, 0.05])
    vectors = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 4)) * scales + 3 * scales)]
    rows = whitening.whiten(table(spark, vectors), components=4).collect()
    _, _, v, deviations = exact(vectors)
    assert {int(r["deviation"]) for r in rows} == set(deviations)
    shares = sorted({r["explained"] for r in rows}, reverse=True)
    # nearly independent dimensions: the determinant is the product of the eigenvalues, exactly
    m = [[Fraction(x) for x in row] for row in v]
    det = Fraction(1)
    for i in range(4):
        det *= m[i][i]
        for j in range(i + 1, 4):
            f = m[j][i] / m[i][i]
            m[j] = [b - f * a for a, b in zip(m[i], m[j], strict=True)]
    assert np.prod(shares) * np.trace(v) ** 4 == pytest.approx(float(det), rel=1e-6)
    assert max(r["identity_error"] for r in rows) < 1e-4


def test_whitening_hard_rows(spark):
    rng = np.random.default_rng(7)
    good = [(k % 30, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 5)))] + [(None, rng.normal(size=5).tolist())]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, [1e300] * 5), (95, [])]
    other = [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (202, [1.5, 9.0])]
    rows = whitening.whiten(table(spark, good + bad + other)).collect()
    assert len(rows) == 41 * 5 + 3 * 2
    assert {r["n"] for r in rows if r["length"] == 5} == {41} and {r["n"] for r in rows if r["length"] == 2} == {3}
    assert all(r["identity_error"] < 1e-9 for r in rows)
    same = whitening.whiten(table(spark, [(k, [0.5, 1.5, 2.5]) for k in range(4)])).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    flat = whitening.whiten(table(spark, [(0, [0.0, 1.0, 7.0]), (1, [1.0, 1.0, 7.0])])).collect()
    assert sorted((r["component"], r["vec_id"], r["whitened"] is None) for r in flat) == [(1, 0, False), (1, 1, False), (2, 0, True), (2, 1, True), (3, 0, True), (3, 1, True)]
    nothing = whitening.whiten(table(spark, []))
    assert nothing.count() == 0 and "whitened" in nothing.columns


def test_whitening_in_parts_of_lengths(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LENGTHS", 1)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    vectors = [(100 * d + k, rng.normal(size=d).tolist()) for d in (2, 3, 4) for k in range(25)]
    rows = whitening.whiten(table(spark, vectors, "float")).collect()
    for d in (2, 3, 4):
        own = [(k, np.float32(v).tolist()) for k, v in vectors if len(v) == d]
        check_whitening([r for r in rows if r["length"] == d], own, d)


def test_limbs_multiply_exactly():
    rng = np.random.default_rng(9)
    for high in (1 << 10, 1 << 30, 1 << 60):
        a, b = rng.integers(-high, high, (50, 3)), rng.integers(-high, high, (50, 2))
        want = [[sum(int(x) * int(y) for x, y in zip(a[:, i], b[:, j], strict=True)) for j in range(2)] for i in range(3)]
        got = whitening.exact_product(a, b)
        assert got.tolist() == want
        assert whitening.unpacked(whitening.packed(got)).tolist() == [x for row in want for x in row]


def test_whitening_query(spark, data):
    rows = queries.op11_tiled_whitening(spark, data).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitening(rows, vectors, 8)


def check_shards(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == n and all(0 <= s < shards for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_hard_rows(spark):
    docs = hard(spark).withColumns({"shard": F.lit("theirs"), "_bucket": F.lit(1), "_place": F.lit("x")})
    path = sharding.write_shards(docs, new_path(spark, "test-shards"))
    for shards in (1, 3, 40):
        rows = sharding.read_shards(spark, path, shards).collect()
        check_shards(rows, len(hard_rows()), shards)
        assert sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=repr) == sorted(((r[0], r[1], r[3]) for r in hard_rows()), key=repr)
        assert all((r["_bucket"], r["_place"], r["size"], r["_n"]) == (1, "x", "clash", 7) for r in rows)
        for k in range(min(shards, 4)):
            one = sharding.read_shards(spark, path, shards, k).collect()
            assert sorted(map(repr, one)) == sorted(repr(r) for r in rows if r["shard"] == k)
    path = sharding.write_shards(empty(spark), new_path(spark, "test-shards"))
    assert sharding.read_shards(spark, path).count() == 0 and sharding.read_shards(spark, path, 4, 2).count() == 0


def test_shards_are_the_shuffle_by_hand(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 2000)
    rows = [(k, "same text" if k % 3 == 0 else f"text {k} " + "x" * (k % 50)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    n = sharding.bucket_count(docs)
    assert n == -(-sum(len(t) + 16 for _, t in rows) // 2000)
    keyed = docs.withColumn("o", F.monotonically_increasing_id()).withColumn("b", F.pmod(F.xxhash64(F.lit(sharding.SEED), "o"), F.lit(n)))
    buckets = defaultdict(list)
    for r in sorted(keyed.collect(), key=lambda r: r["o"]):
        buckets[r["b"]].append(r["doc_id"])
    order = []
    for b in sorted(buckets):
        own, draw = buckets[b], np.random.default_rng([sharding.SEED, b])
        picks = draw.integers(0, np.arange(len(own), 0, -1))
        for i, j in zip(range(len(own) - 1, -1, -1), picks, strict=True):
            own[i], own[j] = own[j], own[i]
        order += own
    path = sharding.write_shards(docs, new_path(spark, "test-shards"))
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.read_shards(spark, path, 7).collect())
    assert [d for _, _, d in got] == order
    check_shards([{"shard": s, "slot": t} for s, t, _ in got], 1500, 7)
    again = sharding.read_shards(spark, sharding.write_shards(docs, new_path(spark, "test-shards")), 7).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"]) for r in again) == got
    other = sharding.read_shards(spark, sharding.write_shards(docs, new_path(spark, "test-shards"), seed=1), 7).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"]) for r in other) != got


def test_shards_spread_copies_and_neighbours():
    places = np.array([np.flatnonzero(sharding.fisher_yates(6, s, 0) == 0)[0] for s in range(3000)])
    counts = np.bincount(places, minlength=6)
    assert abs(counts - 500).max() < 100
    assert sorted(sharding.fisher_yates(1000, 1, 2).tolist()) == list(range(1000)) and len(sharding.fisher_yates(0, 1, 2)) == 0


def test_shards_query(spark, data):
    rows = queries.op12_external_shuffle(spark, data).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check_shards(rows, len(docs), 40)
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {(k, len(t) + 16, zlib.crc32(t), "rows", None) for k, t in docs.items()}


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def random_texts(seed, n, words):
    rng = np.random.default_rng(seed)
    signs = [" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; ", "! ", " ? ", ":"]
    vocabulary = [f"W{k}é" if k % 4 == 0 else f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        picked = rng.zipf(1.3, rng.integers(0, 60)) % words
        text = "".join(vocabulary[w] + signs[min(len(signs) - 1, int(rng.exponential(1.5)))] for w in picked)
        out.append((["en", "de", None, ""][k % 4], text + (" fixed phrase of words here" if k % 3 == 0 else "")))
    return out


@pytest.mark.parametrize("case", range(4))
def test_collocations_against_brute_force(spark, monkeypatch, case):
    rows = random_texts(case, 300, [3, 12, 40, 200][case])
    monkeypatch.setattr(collocations, "SHARD", [50, 400, 100_000, 10][case])
    monkeypatch.setattr(collocations, "VOCABULARY", [400_000, 30, 400_000, 100][case])
    monkeypatch.setattr(collocations, "POSITIONS", [100, 1 << 20, 1 << 20, 100][case])
    monkeypatch.setattr(collocations, "BITS", [27, 16, 15, 27][case])
    monkeypatch.setattr(collocations, "PHRASES", [250_000, 5, 250_000, 20][case])
    monkeypatch.setattr(collocations, "SLICE", [1 << 19, 7, 1 << 19, 100][case])
    if case == 2:  # sets in which every hash meets another: no run is cut, and nothing changes
        monkeypatch.setattr(collocations, "bit_set", lambda hashes, bits: np.full(1 << (bits - 3), 255, np.uint8))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, least=10, top=50)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 10, 50)


def test_collocations_hard_rows(spark):
    rows = [(r[2], r[1]) for r in hard_rows()] * 3 + [(None, "a a a a a"), (None, "A b. a\tb\x0bA B"), ("und", "a \x00 b \x00 b"), ("fr", ". , ;"), (None, None)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "f long, text string, lang string").withColumn("phrase", F.lit("clash"))
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=2, top=2000).collect())
    assert got == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("en", "x y " * 60_000)], "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(one).collect()) == brute_collocations([("en", "x y " * 60_000)], 100, 2000)


def test_collocation_scores_pass_64_bits(spark):
    rows = [(10**15, 9 * 10**16, 10**15, 10**16), (100, 10**17, 100, 100), (7 * 10**14 + 1, 3 * 10**15 + 7, 7 * 10**14 + 3, 9 * 10**14 + 5)]
    table = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r["s"] for r in table.select(collocations.score(*(F.col(c) for c in ("a", "n", "l", "r"))).alias("s")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


@pytest.mark.parametrize("seed", range(5))
def test_suffix_automaton_counts_phrases(seed):
    rng = np.random.default_rng(seed)
    one, want = collocations.SuffixAutomaton(), Counter()
    for _ in range(30):
        sequence = rng.integers(0, 3, rng.integers(1, 25)).tolist()
        known = int(rng.integers(0, 4))
        one.add(sequence, known)
        want.update(tuple(sequence[z - k : z]) for z in range(known + 1, len(sequence) + 1) for k in range(2, 6) if k <= z)
    got = list(one.phrases(2, 5))
    assert len(got) == len({p for p, _ in got})
    assert {p: n for p, n in got if n} == dict(want)
