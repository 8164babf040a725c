"""How runs reach the tasks that count their phrases."""

from collections import Counter

import pyarrow as pa

from meridia.llm import collocations


def test_runs_are_dealt_by_language(spark):
    rows = [(lang, bytearray(f"a b {w} .".encode())) for lang in ("de", "en", "fr") for w in "cdef" * 5]
    found = spark.createDataFrame(rows, "lang string, text binary").repartition(16)
    counts = collocations.phrase_counts(found, [])
    assert "rangepartitioning(lang" in counts._jdf.queryExecution().toString()
    want = Counter()
    for lang, text in rows:
        w = text.decode().split()[:-1]
        want.update((lang, " ".join(w[i:j])) for i in range(3) for j in range(i + 2, 4))
    assert {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()} == want


def test_words_of_a_batch_are_read_in_bounded_groups():
    # one language and long texts: all words of an Arrow batch were held at once before
    most = 1 << 21
    short, long = b"some words, and more. " * 400, b"Words of one text;\nof many pieces\tin all! " * 150_000
    endless = b"no piece ends " * 300_000
    texts = [short] * 900 + [long, b"", endless + b". tail of it", b"last"]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], ["lang", "text"])
    groups = list(collocations._batches([batch]))
    assert {lang for lang, _ in groups} == {"en"}
    assert max(sum(map(len, some)) for _, some in groups if not some[0].startswith(b"no piece")) <= most

    def words(parts):
        return [t for t in collocations.tokens(b".".join(parts)) if t != b"."]

    assert [w for _, some in groups for w in words(some)] == words(texts)


def test_cuts_between_groups_lose_no_phrase(monkeypatch):
    monkeypatch.setattr(collocations, "GROUP", 40, raising=False)
    text = "a b c. a b c, d e\na b c d e f g h i j k l m n o p q r s t u v w x y z. a\tb c; " * 3
    batch = pa.record_batch([pa.array(["en", "de", "en"]), pa.array([text.encode(), b"a b c", b""], pa.binary())], ["lang", "text"])

    def pairs(groups):
        found = Counter()
        for lang, some in groups:
            t = collocations.tokens(b".".join(some))
            found.update((lang, x, y) for x, y in zip(t, t[1:], strict=False) if b"." not in (x, y))
        return found

    groups = list(collocations._batches([batch]))
    assert len(groups) > 6
    assert pairs(groups) == pairs([("en", [text.encode(), b""]), ("de", [b"a b c"])])


def test_tasks_are_as_many_as_their_size_asks_for(spark, monkeypatch):
    rows = [(lang, bytearray(f"a b {w} .".encode())) for lang in ("de", "en") for w in "cdef" * 50]
    found = spark.createDataFrame(rows, "lang string, text binary").repartition(16)
    size, counts = sum(len(text) for _, text in rows), []
    for task, least, tasks in ((1 << 20, 1 << 20, 2), (size // 8, 1 << 20, 8), (1 << 20, size // 3, 3)):
        monkeypatch.setattr(collocations, "TASK", task, raising=False)
        monkeypatch.setattr(collocations, "LEAST_TASK", least, raising=False)
        dealt = collocations.phrase_counts(found, [])
        assert f", {tasks}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
        counts.append(sorted((r["lang"], r["phrase"], r["f"]) for r in dealt.collect()))
    assert counts[0] == counts[1] == counts[2]
    assert len(counts[0]) == 18
