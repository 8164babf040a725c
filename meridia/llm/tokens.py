"""Encoding with the ``tokenizers`` library, once per distinct word instead of once per word.

The pre-tokenizers of the two public vocabularies never form a piece across a space that
follows a non-space character, so the ids of a text are the ids of its space-cut segments
in order. Each worker keeps a bounded table from segment to ids; the library encodes what
is not in it. Other tokenizers are given whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of all tables of a worker together, the longest segment worth keeping, characters of
#: text whose unknown segments are looked up together, and segments encoded in one call.
ROOM, LONGEST, AT_ONCE, JOINED = 256 << 20, 48, 500_000, 200
#: A space after white space and before white space or the end (patterns that begin with one
#: fixed character are searched several times as fast as those that begin with a class).
_UNSAFE = re.compile(r" (?<=\s )(?:\s|$)")
_CUTS = re.compile(r"(?<=\S)(?= )")
#: Line breaks beside other white space or at an end; separators that only Python calls space.
_LINES = re.compile(r"\n(?:\s|$|(?<=\s\n)|(?<=\A\n))")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def public_path(name: str) -> str:
    """Where a public vocabulary lies; works on executors and driver alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Room:
    """Holds a worker's tables to ``ROOM`` bytes in sum: when new entries would exceed it, all
    tables start anew."""

    def __init__(self):
        self.used, self.tables = 0, []

    def add(self, table: dict, new: dict[str, bytes]) -> None:
        size = sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, new.values())) + 100 * len(new)
        if self.used + size > ROOM:
            for t in self.tables:
                t.clear()
            self.used = 0
        self.used += size
        table.update(new)


class _Segments(dict):
    """Segment to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, prefix: str, room: _Room):
        super().__init__()
        self.tokenizer, self.prefix, self.room = tokenizer, prefix, room
        room.tables.append(self)

    def __missing__(self, segment: str) -> bytes:
        ids = self.tokenizer.encode(self.prefix + segment, add_special_tokens=False).ids
        blob = np.asarray(ids, "<u4").tobytes()
        if len(segment) <= LONGEST:
            self.room.add(self, {segment: blob})
        return blob

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments worth keeping, encoded many to a call."""
        found = {}
        for k in range(0, len(segments), JOINED):
            part = segments[k : k + JOINED]
            encs = self.tokenizer.encode_batch_fast([self.prefix + x for x in part], add_special_tokens=False)
            found.update((x, np.asarray(enc.ids, "<u4").tobytes()) for x, enc in zip(part, encs, strict=True))
        self.room.add(self, found)
        return found


class _Local(dict):
    """The segments of the texts at hand, small enough to stay in the processor's cache."""

    def __init__(self, table: _Segments):
        super().__init__()
        self.table = table

    def __missing__(self, segment: str) -> bytes:
        ids = self[segment] = self.table[segment]
        return ids


#: Signs that make a piece of their own after letters (no apostrophe: "'s" is a piece), and
#: the first letter past the scripts on which all Unicode versions agree.
_SIGNS, _LATER = '.,;:!?()[]{}<>|/\\"*#$%&@+=~^_-', "\u0530"


class _Joined:
    """Encodes many unknown segments in one call and takes the ids apart again.

    Most segments are letters and then signs, which the pre-tokenizers part: ids of the
    letters and of the signs are looked up apart, so "word", "word." and "word," are encoded
    once. Letters are joined by spaces; where a space starts the next piece, the tokens that
    start with one show where each begins, and where white space is dropped, each is one
    piece, of which the last token has an end mark."""

    def __init__(self, tokenizer, rule: str, room: _Room):
        self.tokenizer, self.rule, self.room = tokenizer, rule, room
        mark = (lambda t: t.startswith("\u0120")) if rule == "kept" else (lambda t: t.endswith("</w>"))
        self.marks = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.marks[[i for t, i in tokenizer.get_vocab().items() if mark(t)]] = True
        self.letters: dict[str, bytes] = {}
        room.tables.append(self.letters)
        self.signs = _Segments(tokenizer, "", room)

    def learn(self, segments: list[str], found: dict[str, bytes]) -> list[str]:
        """Puts the ids of the segments it can take apart into ``found``, and returns the others."""
        known, signs, lower, open_, others = self.letters.get, self.signs, self.rule == "dropped", [], []
        for x in segments:
            letters = x.rstrip(_SIGNS)
            if not letters.isalpha() or len(letters) > LONGEST:
                others.append(x)
                continue
            if not letters.isascii():
                if max(letters) >= _LATER:
                    others.append(x)
                    continue
            elif lower:
                letters = letters.lower()
            ids = known(letters)
            if ids is None:
                open_.append(x)
            else:
                n = len(letters)
                found[x] = ids + signs[x[n:]] if n < len(x) else ids
        apart = [x.rstrip(_SIGNS) for x in open_]
        keys = [w.lower() if w.isascii() else w for w in apart] if lower else apart
        new, learnt = list(set(keys)), {}
        for k in range(0, len(new), JOINED):
            part = new[k : k + JOINED]
            learnt.update(zip(part, self._encode(part), strict=False))
        for x, letters, key in zip(open_, apart, keys, strict=True):
            ids, n = learnt.get(key), len(letters)
            if ids is None:
                others.append(x)
            else:
                found[x] = ids + signs[x[n:]] if n < len(x) else ids
        self.room.add(self.letters, learnt)
        return others

    def _encode(self, part: list[str]) -> list[bytes]:
        [enc] = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
        ids = np.asarray(enc.ids, "<u4")
        blob, at = ids.tobytes(), np.flatnonzero(self.marks[ids]).tolist()
        if len(at) != len(part):
            return []
        if self.rule == "kept":
            a, b = [4 * x for x in at], [*(4 * x for x in at[1:]), len(blob)]
        else:
            b = [4 * x + 4 for x in at]
            a = [0, *b[:-1]]
        return [blob[x:y] for x, y in zip(a, b, strict=True)]


def _cut_rule(path: str) -> str | None:
    """'kept' where a space starts the next piece, 'dropped' where white space is dropped,
    None where nothing is known about the tokenizer."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    plain = not conf.get("post_processor") and not conf.get("truncation") and not conf.get("padding")
    words = all(not re.search(r"\s", a["content"]) and not (a["lstrip"] or a["rstrip"]) for a in conf["added_tokens"])
    pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
    if not (plain and words and conf["model"]["type"] == "BPE"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "kept"
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in first["pattern"].get("Regex", ""):
        return "dropped"
    return None


class Encoder:
    """``encode(text)`` gives the ids as bytes, four to an id; ``encode_all`` does so for many."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rule = _cut_rule(path)
        room = _Room()
        self.first = _Segments(self.tokenizer, "", room)
        self.rest = _Segments(self.tokenizer, " ", room) if self.rule == "kept" else self.first
        self.joined = _Joined(self.tokenizer, self.rule, room) if self.rule else None

    def _learn(self, segments: set[str]) -> _Local:
        # one table or the other holds a segment; letters with signs are put together each time
        local, letters = _Local(self.rest), self.joined.letters
        local.update((x, letters[x]) for x in segments & letters.keys())
        new, rest = [], self.rest.get
        for x in segments - local.keys():
            ids = rest(x)
            if ids is None:
                new.append(x)
            else:
                local[x] = ids
        local.update(self.rest.learn([x for x in self.joined.learn(new, local) if len(x) <= LONGEST]))
        return local

    def _cut(self, text: str) -> list[list[str]] | None:
        """Words of each line, or None for texts that need another way."""
        if self.rule == "dropped":
            return [text.split(" ") if any(c in text for c in _SEPARATORS) else text.split()]
        if self.rule is None or _UNSAFE.search(text):
            return None
        if "\n" not in text:
            return [text.split(" ")]
        # a line break alone between other characters is a piece, and so is what follows it
        return [line.split(" ") for line in text.split("\n")] if not _LINES.search(text) else [text.split(" ")]

    def _ids(self, text: str, cut: list[list[str]] | None, local: dict[str, bytes] | None = None) -> bytes:
        if cut is None:
            if self.rule is None:
                return self.first.__missing__(text)
            return b"".join(map(self.first.__getitem__, _CUTS.split(text)))
        first, rest = self.first.__getitem__, (self.rest if local is None else local).__getitem__
        if self.rule == "dropped":
            return b"".join(map(rest, cut[0]))
        return first("\n").join([first(words[0]) + b"".join(map(rest, words[1:])) for words in cut])

    def encode(self, text: str | None) -> bytes:
        return self._ids(text, self._cut(text)) if text else b""

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """In order; holds the words of about AT_ONCE characters and one text."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= AT_ONCE:
                yield from self._together(held)
                held, chars = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [self._cut(t) for t in texts]
        local = None
        if self.joined:
            lines = [words for c in cuts if c for words in c]
            if self.rule == "kept":  # a line's first word has no space before it
                self.first.learn([x for x in {words[0] for words in lines} if len(x) <= LONGEST and x not in self.first])
                lines = [words[1:] for words in lines]
            local = self._learn(set().union(*lines))
        for text, cut in zip(texts, cuts, strict=True):
            yield self._ids(text, cut, local) if text else b""

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4


@functools.cache
def encoder(name_or_path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(name_or_path if "/" in name_or_path else public_path(name_or_path))
