"""Token counts with overlap resynchronisation.

A huge text, that is one of over ``CHUNK`` characters, is encoded in chunks that overlap. Two
neighbouring chunks are spliced at a position inside the overlap at which both encodings
start a new pre-token. That is a proof, not a heuristic: the pre-tokenizer scans from left to
right without looking back, so two scans that both stop at one position agree on all that
follows; and what stands before the position is right in the earlier chunk, because its
end, at least ``GUARD`` characters later, can't reach back. Where the overlap holds no such
position it is doubled. Where the earlier chunk has no boundary at all (a text without
breaks), no overlap can help: the chunk itself grows ``GROWTH`` times, so that unbroken text
costs little more than its own encoding, not its square.

Memory per text is a few chunks, or ``GROWTH`` times the longest run without a boundary; one row
of output per document.

Defined results: null counts as empty (0 bytes, 0 tokens); ids may be null or repeat, each
row is counted by itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.names import quoted

from .scratch import bound_batches
from .tokens import encoder

CHUNK, OVERLAP, GUARD, GROWTH = 16_384, 512, 64, 4
VOCABULARY = "byte_bpe_50k.json"


def _piece_starts(enc, base: int) -> dict[int, int]:
    """Position in the text to token number, for tokens that start a pre-token."""
    starts, last = {}, object()
    for i, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word is None or word != last:
            starts.setdefault(base + a, i)
        last = word
    return starts


def splice_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> int:
    """Tokens of the whole text, from chunks spliced at proven boundaries."""

    def run(a: int, b: int):
        enc = tokenizer.encode(text[a:b], add_special_tokens=False)
        return enc, _piece_starts(enc, a)

    n, total = len(text), 0
    begin, end = 0, min(n, chunk)  # begin: where the chunk was cut; skip: its tokens already counted
    enc, starts = run(begin, end)
    skip = 0
    while end < n:
        bound = [p for p, i in starts.items() if begin < p <= end - guard and i >= skip]
        width, spliced = max(overlap, end - max(bound, default=end) + guard), False  # back to the last boundary at least
        while bound and not spliced:
            cut = max(begin + 1, end - width)
            to = min(n, end + max(chunk, end - cut))  # as much is new as is encoded again
            nxt, nxt_starts = run(cut, to)
            # the first pre-token of the later chunk may be cut in two, so it starts nothing
            shared = [p for p in bound if p > cut and p in nxt_starts]
            if shared:
                p = max(shared)
                total += starts[p] - skip
                enc, starts, skip, begin, end, spliced = nxt, nxt_starts, nxt_starts[p], cut, to, True
            elif cut == begin + 1:
                break
            else:
                width *= 2
        if not spliced:  # the chunk grows; what is counted of it stays so
            end = min(n, begin + GROWTH * (end - begin))
            enc, starts = run(begin, end)
    return total + len(enc.ids) - skip


def text_token_counts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    e = encoder(vocabulary)
    short = (None if t and len(t) > CHUNK else t for t in texts)
    return [splice_count(e.tokenizer, t) if t and len(t) > CHUNK else len(ids) // 4 for t, ids in zip(texts, e.encode_all(short), strict=True)]


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. No shuffle."""

    def run(batches):
        for b in batches:
            counts = pa.array(text_token_counts(b.column(2).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    bound_batches(docs.sparkSession)
    text = docs[quoted(text_col)]
    rows = docs.select(docs[quoted(id_col)].alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
