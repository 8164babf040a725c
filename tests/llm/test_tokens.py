import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from meridia.llm import packing, token_counts, token_files
from meridia.llm.scratch import materialize
from meridia.llm.tokens import encoder
from tests.llm.helpers import empty, hard, hard_rows

PARTS = ["a", "b", "  ", " ", "\n", "\t", " \n", "'s", "'", "é", "é", "<|endoftext|>", "<|endo", "123", "!?", " ", "中文", "\x1c", "Σ", "ΑΣ", "　", "I'll", "§", " § ", "Ġ"]


def plain(name, text):
    return np.asarray(encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, spark, data):
    r = random.Random(3)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(3000)]
    texts += [x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(80).collect()]
    assert list(encoder(name).encode_all(texts)) == [plain(name, t) for t in texts]


def test_splice_equals_library():
    tokenizer, r = encoder("byte_bpe_50k.json").tokenizer, random.Random(4)
    for _ in range(400):
        text = "".join(r.choices(PARTS, k=r.randint(0, 300)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert token_counts.splice_count(tokenizer, text, 40, 8, 16) == want
    for text in ("a" * 5000, " " * 5000, "ab " * 3000, "\n" * 100 + "x" * 3000):  # no boundary for long: chunks merge
        assert token_counts.splice_count(tokenizer, text, 512, 16, 16) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab9" * 150_000 + " end", "\n" * 40_000 + "x" * 200_000 + " y " * 9000, " " * 100_000])
def test_splice_of_long_unbroken_text(text):
    """Each character is encoded a bounded number of times, also where no boundary is found."""
    tokenizer, sent = encoder("byte_bpe_50k.json").tokenizer, []

    class Counting:
        def encode(self, part, **options):
            sent.append(len(part))
            return tokenizer.encode(part, **options)

    assert token_counts.splice_count(Counting(), text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert sum(sent) < 4 * len(text)


def test_worker_tables_are_bounded(monkeypatch):
    from meridia.llm import tokens

    monkeypatch.setattr(tokens, "ROOM", 100_000)
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) + r.choice(["", ".", "é"]) for _ in range(400)) for _ in range(20)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(tokens.public_path(name))
        assert list(e.encode_all(texts)) == [plain(name, t) for t in texts]
        assert sum(len(k) + len(v) for t in (e.first, e.rest, e.joined.letters, e.joined.signs) for k, v in t.items()) < 100_000 + 10 * max(map(len, texts)) * 20


def test_token_counts(spark, data):
    for docs in (hard(spark), spark.read.parquet(f"{data}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = [(i, len((t or "").encode()), len(plain("byte_bpe_50k.json", t)) // 4) for i, t in rows]
        got = token_counts.count_tokens(docs).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_files_round_trip(spark, data):
    for docs in (hard(spark), spark.read.parquet(f"{data}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = token_files.read_token_files(token_files.write_token_files(docs)).collect()
        end = np.asarray([2], "<u4").tobytes()
        assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=repr) == sorted(((i, plain("byte_bpe_50k.json", t) + end) for i, t in rows), key=repr)
        at, last = 0, -1
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
            assert (-1 if r["doc_id"] is None else r["doc_id"]) >= last
            at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark))).count() == 0


def test_token_files_begin_anew_at_a_bound(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    docs = spark.createDataFrame([(k // 2, f"text number {k}") for k in range(100)], "doc_id long, text string").coalesce(2)
    manifest = token_files.write_token_files(docs)
    assert manifest.agg({"n_docs": "max"}).first()[0] <= 7 and manifest.count() >= 15
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [k // 2 for k in range(100)]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(100)]


def test_token_files_open_only_what_holds_an_id(spark, monkeypatch):
    import os

    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    rows = [(k if k % 9 else None, f"text number {k}") for k in range(100)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    files = {r["path"]: (r["low"], r["high"]) for r in manifest.collect()}
    folder = os.path.dirname(next(iter(files))).removeprefix("file://")
    held = {r["doc_id"] for r in token_files.read_token_files(manifest).collect()}
    assert held == {i for i, _ in rows} and (None, None) in files.values()
    for path, (low, high) in files.items():  # files that can't hold it are damaged: opening one would raise
        if low is None or not low <= 41 <= high:
            open(path.removeprefix("file://"), "wb").close()
    assert [r["doc_id"] for r in token_files.read_token_files(manifest, {41, -5, 1000}).collect()] == [41]
    assert token_files.read_token_files(manifest, set()).count() == 0
    run, other = os.path.basename(next(iter(files)))[:12], "ids-00000000-000000-00000-aa.zst"
    for name in (f"{run}-000000-00000-late.zst", other):
        open(f"{folder}/{name}", "wb").close()
    token_files.remove_unnamed(manifest, f"file://{folder}", run)
    assert set(os.listdir(folder)) - {x for x in os.listdir(folder) if x.endswith(".crc")} == {os.path.basename(p) for p in files} | {other}


def test_store_names_of_spark_and_of_the_writer():
    assert token_files.writer_uri("s3a://bucket/a") == token_files.writer_uri("s3n://bucket/a") == "s3://bucket/a"
    assert token_files.writer_uri("file:///a/s3a://b") == "file:///a/s3a://b"


def test_token_files_read_few_frames_and_check_them(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} " * 3000) for k in range(60)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(docs)
    some = token_files.read_token_files(manifest, {7, 41}).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 41]
    path = manifest.first()["path"]
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        reader = token_files.Reader(f)
        seen = []
        whole = reader._frame
        monkeypatch.setattr(reader, "_frame", lambda k: seen.append(k) or whole(k))
        reader.document(0)
        assert set(seen) == {0} and len(reader.packed) > 3
    with fs.open_input_file(name) as f:
        raw = bytearray(f.read())
    raw[40] ^= 1
    with fs.open_output_stream(name) as f:
        f.write(bytes(raw))
    with fs.open_input_file(name) as f, pytest.raises(Exception):  # noqa: B017  zstandard's own error or ours
        token_files.Reader(f).document(0)


def brute_best_fit(lengths, capacity):
    bins, used, place = [], 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [(left, b) for b, left in enumerate(bins) if left >= lengths[i]]
        if fit:
            left = min(fit)[0]
            place.append(left)
            bins[min(fit)[1]] -= lengths[i]
        else:
            place.append(capacity)
            bins.append(capacity - lengths[i])
    return place, len(bins)


def test_best_fit_decreasing_is_tightest():
    r = random.Random(2)
    for capacity in (1, 7, 64, 2048):
        for _ in range(30):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
            place, offset = packing.best_fit_decreasing(lengths, capacity)
            used = {}
            chosen = []
            for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
                chosen.append(capacity - used.get(place[i], 0))
                assert offset[i] == used.get(place[i], 0)
                used[place[i]] = used.get(place[i], 0) + lengths[i]
                assert used[place[i]] <= capacity
            want, bins = brute_best_fit(lengths, capacity)
            assert chosen == want and len(used) == bins


def test_packing_keeps_ids_beside_nulls_and_other_columns(spark):
    rows = [(k, i, 0, n, 7, 8, 9) for k, (i, n) in enumerate([(9007199254740993, 5), (None, 3), (9007199254740995, 2048), (1, 1), (1, 1)])]
    pieces = spark.createDataFrame(rows, "_row long, doc_id long, piece int, length long, _group int, other int, offset int")
    got = packing.pack(pieces).collect()
    assert sorted((repr(r["doc_id"]), r["length"], r["_group"], r["other"]) for r in got) == sorted((repr(r[1]), r[3], 7, 8) for r in rows)
    assert sorted(r["offset"] for r in got) == [0, 0, 5, 8, 9]


def test_packing_covers_every_document(spark, data):
    for docs, group in ((hard(spark), 5), (spark.read.parquet(f"{data}/documents.parquet"), 16_384)):
        pieces = materialize(packing.tokenized_pieces(docs), "test-pieces")
        rows = packing.pack(pieces, group=group).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r["_row"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        want = sorted(((r["doc_id"], plain("word_bpe_49k.json", r["text"]) + bytes(4)) for r in docs.select("doc_id", "text").collect()), key=repr)
        got = []
        for parts in by_doc.values():
            parts.sort(key=lambda r: r["piece"])
            assert [p["piece"] for p in parts] == list(range(len(parts)))
            assert all(p["length"] == 2048 for p in parts[:-1]) and [p["start"] for p in parts] == [2048 * k for k in range(len(parts))]
            got.append((parts[0]["doc_id"], b"".join(bytes(p["ids"]) for p in parts)))
        assert sorted(got, key=repr) == want
        for parts in by_seq.values():
            at = 0
            for p in sorted(parts, key=lambda r: r["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= 2048
        total = sum(r["length"] for r in rows)
        if group > 1000:
            assert len(by_seq) <= 1.02 * -(-total // 2048) + 1
    assert packing.pack(materialize(packing.tokenized_pieces(empty(spark)), "test-none")).count() == 0
    assert zlib.crc32(b"") == 0
