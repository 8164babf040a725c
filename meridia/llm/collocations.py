"""Phrase collocations by suffix automata per shard.

Texts (A-Z lower-cased) are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words; all
counts are per language.

1. Words are counted in each task and summed globally.
2. A phrase is no more frequent than any phrase in it. So texts are cut where a word, then where a
   pair of neighbours, is below the threshold. What is left are runs, written as a table that all
   later steps read; then runs are cut where a triple, then where a phrase of four words, is below
   it. Every candidate lies wholly in what is left. Pairs and longer phrases are counted by
   64-bit hashes, in slices of the hashes' range that grow in number with the corpus; the frequent
   ones reach the tasks as bit sets of at most 2^``BITS`` bits whatever the corpus: where hashes
   meet, a run is cut less than it could be, and nothing is lost.
3. What is left is dealt to shards of a bounded number of words. A generalised suffix automaton of a
   shard (one automaton for many sequences) gives each state the number of its end positions.
   A state stands for the phrases that end at the same places: the suffixes of its longest
   one that are longer than its suffix link's. So each state names its phrases of 2 to
   ``DEPTH`` words once, with their number.
4. Counts of all shards are summed by language and phrase; those at the threshold are candidates.
5. A candidate's cuts are joined with the counts of both parts, which are candidates or frequent
   words themselves. Scores are exact decimals of 38 digits.
6. Subsumption by links: from a candidate one link leads to its suffix without the first word (the
   automaton's suffix link, where their counts differ) and one to its prefix without the last. If any
   longer candidate that holds a phrase is as frequent, one of a single word more is, as its
   count lies between both. So the largest count over both kinds of links decides.

Each step is a scan or an aggregation combined on the map side; the joins' keys are unique on one
side. Ranks are taken in two levels, so no task ranks more than ``FAN_IN`` times the rows asked for.

Defined results: null texts are empty, null languages ``und``; repeated rows and equal texts count as
often as they occur; very long texts are read whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted

from .scratch import Workspace, bound_batches, materialize

DEPTH, LEAST, TOP = 5, 100, 2000
#: Bits of a set of frequent hashes, as a power of two; words of a shard's automaton; words of a
#: task's vocabulary before it is flushed; word positions that are counted at once.
BITS, SHARD, VOCABULARY, POSITIONS = 27, 100_000, 250_000, 1 << 21
#: Bytes of text of a language whose words are held at once, about.
GROUP = 1 << 21
#: Bytes of runs of a task, and the least that are worth a task of their own where cores are free.
TASK, LEAST_TASK = 3 << 23, 1 << 21
#: Different phrases of a task's shards that are held before they are sent.
PHRASES = 250_000
#: Hashes of a slice that are summed at once, about.
SLICE = 1 << 19
#: First-level groups of the ranking.
FAN_IN = 32
#: Signs that end a piece are all made one sign, which no word can hold.
_END = b"."
_SIGNS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d\x09", b"." * 9 + b" ")


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, with ``.`` wherever a piece ends."""
    return (text.lower().translate(_SIGNS) + _END).replace(_END, b" . ").split()


class _Vocabulary(dict):
    """Numbers of a language's words as they come; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.lang, self.words, self.seed = lang, [_END], xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        found = tokens(_END.join(texts))
        ids = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        known = len(self.hashes)
        if len(self.words) > known:
            new = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in self.words[known:]), np.uint64, len(self.words) - known)
            self.hashes = np.concatenate([self.hashes, new])
        return ids


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of phrases from the hashes of what is before the last word and of that."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(31)) | (second >> np.uint64(33)))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text as it is, or in parts of about ``GROUP`` bytes that end where a piece does."""
    if len(text) <= GROUP:
        yield text
        return
    text, at = text.translate(_SIGNS), 0
    while at < len(text):
        end = text.rfind(_END, at, at + GROUP)
        if end < 0:  # a piece that is longer
            end = text.find(_END, at + GROUP)
        end = len(text) if end < 0 or len(text) - at <= GROUP else end + 1
        yield text[at:end]
        at = end


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of each language of each batch, of about ``GROUP`` bytes at most."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in _pieces(text.as_py()):
                if lang in held and size[lang] + len(part) > GROUP:
                    yield lang, held.pop(lang)
                    size[lang] = 0
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
        yield from held.items()


class _Words:
    """Vocabularies of a task's languages."""

    def __init__(self):
        self.of: dict[str, _Vocabulary] = {}

    def __getitem__(self, lang: str) -> _Vocabulary:
        if lang not in self.of:
            self.of[lang] = _Vocabulary(lang)
        return self.of[lang]

    def __len__(self) -> int:
        return sum(map(len, self.of.values()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f, h): number of each word and its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _Words(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, v in words.of.items():
                n = counts[lang]
                yield pa.record_batch([pa.array([lang] * (len(n) - 1), pa.string()), pa.array(v.words[1 : len(n)], pa.binary()), pa.array(n[1:]), pa.array(v.hashes[1 : len(n)].view(np.int64))], ["lang", "word", "f", "h"])

        for lang, some in _batches(batches):
            ids = words[lang].numbers(some)
            found = np.bincount(ids, minlength=len(words[lang].words))
            before = counts.get(lang, np.zeros(0, np.int64))
            found[: len(before)] += before
            counts[lang] = found
            if len(words) > VOCABULARY:
                yield from flush()
                words, counts = _Words(), {}
        yield from flush()

    found = texts.mapInArrow(run, "lang string, word binary, f long, h long")
    return found.groupBy("lang", F.col("word").cast("string").alias("phrase"), "h").agg(F.sum("f").alias("f"))


def bit_set(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes (column h) that occur, built on the executors in slices of 4 kB; what
    reaches the driver has 2^bits bits at most (and 2^15 at least: a slice)."""
    place = (F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("p")  # Spark counts places from 1
    slices = hashes.select(place).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in slices.toLocalIterator():
        at = (r["b"] - 1) * 4096
        data = np.frombuffer(bytes(r["m"]), np.uint8)
        found[at : at + len(data)] = data
    return found


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent(v: _Vocabulary, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which positions hold a frequent word."""
    known = has(words, v.hashes)
    known[0] = False
    return known[ids]


def _in_slices(hashes: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """(slice, h, f): the hashes and their numbers, packed by slice of the hashes' range."""
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    of = (h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    at = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(h)]])
    spans = [(a, z) for a, z in zip(at[:-1], at[1:], strict=True) if z > a]
    return pa.record_batch(
        [pa.array([int(of[a]) for a, _ in spans], pa.int64()), pa.array([h[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([n[a:z].astype(np.int64).tobytes() for a, z in spans], pa.binary())], ["slice", "h", "f"]
    )


def frequent_hashes(counted: DataFrame, least: int) -> DataFrame:
    """(h) of the hashes whose numbers add up to ``least``. Slices are added up one after the
    other, and within one what is held is reduced whenever it has grown by ``SLICE``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, many, bound = None, [], 0, SLICE

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([x for x, _ in held])
            order = np.argsort(h, kind="stable")
            h, n = h[order], np.concatenate([x for _, x in held])[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], np.add.reduceat(n, at)

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                h, n = summed()
                yield pa.record_batch([pa.array(h[n >= least].view(np.int64))], ["h"])

        for batch in batches:
            for number, h, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if number != now:
                    yield from done()
                    now, held, many, bound = number, [], 0, SLICE
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(f, np.int64)))
                many += len(h) // 8
                if many > bound:
                    held = [summed()]
                    many, bound = len(held[0][0]), len(held[0][0]) + SLICE
        yield from done()

    return counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "h long")


def pair_counts(texts: DataFrame, words: np.ndarray, slices: int) -> DataFrame:
    """(slice, h, f): number of each pair of neighbouring frequent words, by its hash."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, many = _Words(), [], 0
        for lang, some in _batches(batches):
            v = words[lang]
            ids = v.numbers(some)
            good = _frequent(v, ids, sent.value)
            at = np.flatnonzero(good[:-1] & good[1:])
            held.append(pair_hashes(v.hashes[ids[at]], v.hashes[ids[at + 1]]))
            many += len(at)
            if len(words) > VOCABULARY:
                words = _Words()
            if many > POSITIONS:
                yield _in_slices(held, slices)
                held, many = [], 0
        if many:
            yield _in_slices(held, slices)

    return texts.mapInArrow(run, "slice long, h binary, f binary")


def runs(texts: DataFrame, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(lang, text): the texts' runs of frequent words and pairs, each ended by a ``.``"""
    sent = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for lang, some in _batches(batches):
            v = words[lang]
            ids = v.numbers(some)
            good = _frequent(v, ids, sent.value[0])
            near = good[:-1] & good[1:]
            near[near] = has(sent.value[1], pair_hashes(v.hashes[ids[:-1][near]], v.hashes[ids[1:][near]]))
            near = np.concatenate([[False], near, [False]])
            # a word stays with a pair on either side; a run ends where no pair goes on
            stays, ends = near[:-1] | near[1:], near[:-1] & ~near[1:]
            out = np.flatnonzero(stays)
            found = np.insert(ids[out], np.flatnonzero(ends[out]) + 1, 0)
            if len(found):
                yield pa.record_batch([pa.array([lang]), pa.array([b" ".join(map(v.words.__getitem__, found.tolist()))], pa.binary())], ["lang", "text"])
            if len(words) > VOCABULARY:
                words = _Words()

    return texts.mapInArrow(run, "lang string, text binary")


def _levels(v: _Vocabulary, ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs and the bit sets of frequent triples and what is longer by a word each: the words
    of the longest known frequent phrase that ends at each position (0 for none), and where the
    phrases of one word more can begin, with their hashes."""
    longest, words = np.zeros(len(ids), np.int64), v.hashes[ids]
    begins, h = (ids[:-1] > 0) & (ids[1:] > 0), pair_hashes(words[:-1], words[1:])
    longest[1:][begins] = 2
    for k, bits in enumerate(sets, 3):
        begins, h = begins[:-1] & begins[1:], pair_hashes(h[:-1], words[k - 1 :])
        begins[begins] = has(bits, h[begins])
        longest[k - 1 :][begins] = k
    return longest, begins[:-1] & begins[1:], pair_hashes(h[:-1], words[len(sets) + 2 :])


def longer_counts(found: DataFrame, sets: list[np.ndarray], slices: int) -> DataFrame:
    """(slice, h, f): number of each phrase in runs that is a word longer than those of the last
    of the sets (pairs, if there is none) and made of two of them, by its hash."""
    sent = found.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, many = _Words(), [], 0
        for lang, some in _batches(batches):
            v = words[lang]
            _, begins, h = _levels(v, v.numbers(some), sent.value)
            held.append(h[begins])
            many += len(held[-1])
            if len(words) > VOCABULARY:
                words = _Words()
            if many > POSITIONS:
                yield _in_slices(held, slices)
                held, many = [], 0
        if many:
            yield _in_slices(held, slices)

    return found.mapInArrow(run, "slice long, h binary, f binary")


def sequences(longest: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(begin, first counted end, end) of what is left of runs, from the words (``most`` at most) of
    the longest frequent phrase that ends at each position. Of two that overlap, the later one's
    signs before its first counted end were counted by the earlier one, so each phrase counts once."""
    some = longest >= 2
    goes_on = np.zeros(len(longest), bool)
    goes_on[1:] = some[1:] & some[:-1] & (longest[1:] == np.minimum(most, longest[:-1] + 1))
    heads, last = np.flatnonzero(some & ~goes_on), np.flatnonzero(some & ~np.append(goes_on[1:], False))
    return list(zip((heads - longest[heads] + 1).tolist(), heads.tolist(), last.tolist(), strict=True))


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of numbers, with end positions counted."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends, self.seen = [-1], [0], [0], [-1]
        self.text: list[int] = []

    def _state(self, length: int, ends: int, link: int, seen: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.ends.append(ends)
        self.link.append(link)
        self.seen.append(seen)
        return len(self.next) - 1

    def _split(self, p: int, sign: int, q: int) -> int:
        """The state of the suffixes of ``q`` that ``p`` reaches, taken out of it."""
        copy = self._state(self.length[p] + 1, 0, self.link[q], self.seen[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(sign) == q:
            self.next[p][sign] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], known: int = 0) -> None:
        """Adds a sequence of its own: no phrase reaches from another one into it. Phrases that
        end in its first ``known`` signs are not counted: they were where those came from."""
        following, length, link, last = self.next, self.length, self.link, 0
        for k, sign in enumerate(sequence):
            at, counted = len(self.text), int(k >= known)
            self.text.append(sign)
            q = following[last].get(sign)
            if q is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._split(last, sign, q)
                self.ends[last] += counted
                continue
            new = self._state(length[last] + 1, counted, 0, at, {})
            p = last
            while p >= 0 and sign not in following[p]:
                following[p][sign] = new
                p = link[p]
            if p >= 0:
                q = following[p][sign]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, sign, q)
            last = new

    def phrases(self, shortest: int, longest: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Each phrase of these lengths once, with its number of end positions."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1].tolist()
        ends = list(self.ends)
        for state in order[:-1]:  # the root, of length 0, is the last
            ends[self.link[state]] += ends[state]
        for state in order[:-1]:
            low, high, z = max(shortest, self.length[self.link[state]] + 1), min(longest, self.length[state]), self.seen[state] + 1
            for k in range(low, high + 1):
                yield tuple(self.text[z - k : z]), ends[state]


def phrase_counts(found: DataFrame, sets: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f) of the phrases of 2 to DEPTH words in runs, from automata of shards."""
    sent = found.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, automata = _Words(), {}
        counts: dict[str, dict[bytes, int]] = {}  # of the task's shards, so that what they share is sent once

        def count(lang: str) -> None:
            v, own = words[lang], counts.setdefault(lang, {})
            for phrase, n in automata.pop(lang).phrases(2, DEPTH):
                text = b" ".join(map(v.words.__getitem__, phrase))
                own[text] = own.get(text, 0) + n

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                rows = iter(own.items())
                while some := list(islice(rows, 50_000)):
                    yield pa.record_batch([pa.array([lang] * len(some)), pa.array([text for text, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "f"])
            counts.clear()

        for lang, some in _batches(batches):
            v = words[lang]
            ids = v.numbers(some)
            longest, _, _ = _levels(v, ids, sent.value)
            signs = ids.tolist()
            for begin, head, last in sequences(longest, 2 + len(sent.value)):
                for at in range(head, last + 1, SHARD):  # a sequence of many shards: each goes on where the last one ended
                    one = automata.setdefault(lang, SuffixAutomaton())
                    start = max(begin, at - DEPTH + 1)
                    one.add(signs[start : min(last + 1, at + SHARD)], at - start)
                    if len(one.text) >= SHARD:
                        count(lang)
            if len(words) > VOCABULARY or sum(len(a.text) for a in automata.values()) > SHARD:
                for name in list(automata):
                    count(name)
                if len(words) > VOCABULARY:
                    words = _Words()
            if sum(map(len, counts.values())) > PHRASES:
                yield from flush()
        for name in list(automata):
            count(name)
        yield from flush()

    # by ranges of the language: a phrase is then met by the tasks of its own language alone; and to no more
    # tasks than their size asks for, as each sends the phrases that it has met
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(2, size // TASK, min(found.sparkSession.sparkContext.defaultParallelism, size // LEAST_TASK))
    dealt = found.repartitionByRange(tasks, "lang", F.xxhash64("text"))
    rows = dealt.mapInArrow(run, "lang string, phrase binary, f long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = (wide(a, 16) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide(n, 18)
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(l, 18) * wide(r, 18)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases by score."""
    spark = docs.sparkSession
    bound_batches(spark)
    lang, text = docs[quoted(lang_col)], docs[quoted(text_col)]
    texts = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    work = Workspace(spark, "collocations")
    words = work.keep(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    word_bits = bit_set(frequent, BITS)
    slices = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // SLICE)
    pair_bits = bit_set(frequent_hashes(pair_counts(texts, word_bits, slices), least), BITS)
    found = work.keep(runs(texts, word_bits, pair_bits), "runs")
    sets: list[np.ndarray] = []
    for _ in range(3, DEPTH):
        sets.append(bit_set(frequent_hashes(longer_counts(found, sets, slices), least), BITS))
    candidates = work.keep(phrase_counts(found, sets).filter(F.col("f") >= least), "candidates")

    known = frequent.select("lang", "phrase", "f").unionByName(candidates)
    parts = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, DEPTH), " ").alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cut.join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    longer = candidates.filter(F.size(parts) > 2)
    links = F.explode(F.array(F.expr("substr(phrase, instr(phrase, ' ') + 1)"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")))
    within = longer.select("lang", links.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = rows.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(FAN_IN)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    out = materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    work.drop()
    return out
