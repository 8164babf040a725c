"""Best-fit-decreasing packing of documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` ids (``tokenized_pieces``). Full pieces are
sequences of their own. The others are dealt at random into groups of about ``GROUP``
pieces, and each group is packed by itself: pieces in order of falling length, each into the
tightest open bin that still holds it. A segment tree over the remaining capacities finds
that bin in logarithmic time. A group leaves about one sequence open, so the loss against
one large group is about one sequence in several thousand, and no task sees more than
``GROUP`` pieces whatever the size of the corpus.

Defined results: ids are whole numbers (an id column of another type must
hold such, as anything else is an error); null text counts as empty and gives a piece with the end id alone; ids may
be null or repeat, each row is packed by itself; an empty table gives an empty result; extra
columns are ignored by ``tokenized_pieces`` and carried along by ``pack`` unchanged, but for
columns named sequence_id or offset, which its own replace.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.names import quoted, unused

from .scratch import bound_batches
from .tokens import encoder

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 0, 2048
#: Pieces packed together, on average.
GROUP = 16_384
_PIECES = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
_BATCH_BYTES = 4 << 20


def tokenized_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian 32 bits) and _row, a number
    of the piece's document that is unique within one run. No shuffle."""
    end = struct.pack("<I", end_id)

    def run(batches):
        e, row, held, size = encoder(vocabulary), TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), e.encode_all(x.as_py() for x in b.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    held.append((row, i, k, at // 4, len(part) // 4, part))
                row, size = row + 1, size + len(ids)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PIECES, strict=True)], schema=_PIECES)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PIECES, strict=True)], schema=_PIECES)

    bound_batches(docs.sparkSession)
    rows = docs.select(docs[quoted(id_col)].cast("long"), docs[quoted(text_col)])
    return rows.mapInArrow(run, "_row long, doc_id long, piece int, start long, length long, ids binary")


class OpenBins:
    """Bins by remaining capacity. ``tree[k]`` says whether any bin's remaining capacity
    lies below node k of a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, number: int) -> None:
        if not self.bins[remaining]:
            k = self.leaves + remaining
            while k and not self.tree[k]:
                self.tree[k] = 1
                k >>= 1
        self.bins[remaining].append(number)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (remaining, number) of the tightest bin for ``length``."""
        tree, k = self.tree, self.leaves + length
        while not tree[k]:  # up, until a subtree to the right holds a bin
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:  # down to its smallest remaining capacity
            k = 2 * k if tree[2 * k] else 2 * k + 1
        remaining = k - self.leaves
        number = self.bins[remaining].pop()
        if not self.bins[remaining]:
            tree[k] = 0
            while k > 1 and not (tree[k] or tree[k ^ 1]):
                k >>= 1
                tree[k] = 0
        return remaining, number


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length; lengths over the capacity are not allowed."""
    bins, used, n = OpenBins(capacity), [0] * len(lengths), 0
    place, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = bins.take(lengths[i])
        remaining, b = found or (capacity, n)
        n += not found
        place[i], offset[i] = b, used[b]
        used[b] += lengths[i]
        if remaining > lengths[i]:
            bins.put(remaining - lengths[i], b)
    return place, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` has _row, piece and length, is cheap to read
    twice (a written table), and keeps its other columns."""
    pieces = pieces.drop("sequence_id", "offset")
    [group_col] = unused(pieces.columns, "_group")
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    full = pieces.filter(F.col("length") >= capacity)
    part = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        length, row, piece = (rows[c].to_numpy() for c in ("length", "_row", "piece"))
        order = np.lexsort([piece, row, -length])
        rows = rows.drop_columns([group_col]).take(pa.array(order))
        place, offset = best_fit_decreasing(length[order].tolist(), capacity)
        number = (key[0].as_py() << 32) + np.array(place, np.int64)
        return rows.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset, pa.int64()))

    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    dealt = part.withColumn(group_col, F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)))
    return dealt.groupBy(group_col).applyInArrow(run, schema).unionByName(alone)
