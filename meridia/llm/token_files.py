"""Token ids in seekable zstandard files.

One file holds the ids of a run of documents as little-endian unsigned 32-bit integers:

* zstandard frames, each independent of the others. A frame ends after a document once it
  holds ``FRAME_BYTES``; a longer document takes several frames;
* a skippable frame with the directory: for each document its id, whether the id is null,
  and its number of ids (zstandard-compressed columns);
* the public seek table of the zstandard seekable format: a skippable frame with compressed
  size, decompressed size and checksum (low half of XXH64) of each frame, then its footer.

A reader takes the footer, the seek table and the directory from the end of a file and then
decompresses only the frames that hold what is asked for, checking each frame's checksum.

Documents are dealt out by range of id, so file k holds smaller ids than file k + 1. A task
closes a file that holds ``FILE_DOCS`` documents or ``FILE_BYTES`` of ids and begins the next, so
what a writer keeps and a reader loads of a directory is bounded. Each attempt of a task
writes files of its own names; only files named in the manifest that Spark commits are ever
read, so lost executors and repeated tasks do no harm. Files of the run that no manifest names
are removed once it is written. The manifest has each file's smallest and largest id, so a
request for some ids opens no files but those whose range holds one.

Files are written where pyarrow can write: file, hdfs, gs, abfss, and s3 (also named s3a or
s3n, as Spark does).

Defined results: ids are whole numbers (an id column of another type must
hold such, as anything else is an error); null text counts as empty, an empty document has only the end id; null ids
come first; rows that tie on id follow the hash of their text; every row gets its place.
Empty input gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted

from .scratch import bound_batches, materialize, new_path
from .tokens import encoder

FRAME_BYTES, FILE_BYTES, FILE_DOCS = 1 << 18, 1 << 28, 100_000
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
# Fixed values of the public seekable format.
SEEK_TABLE_MAGIC, DIRECTORY_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, low long, high long"
_BATCH_BYTES = 4 << 20


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, out, level: int = 3):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.held, self.size, self.frames = [], 0, []
        self.ids, self.nulls, self.counts = array("q"), array("B"), array("Q")
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def span(self) -> tuple[int | None, int | None]:
        """Smallest and largest document id."""
        ids = np.asarray(self.ids)[np.asarray(self.nulls) == 0]
        return (int(ids.min()), int(ids.max())) if len(ids) else (None, None)

    def _flush(self) -> None:
        data = b"".join(self.held)
        for k in range(0, len(data), FRAME_BYTES):
            part = data[k : k + FRAME_BYTES]
            frame = self.zip.compress(part)
            self.out.write(frame)
            self.frames.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        columns = np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.nulls, "u1").tobytes() + np.asarray(self.counts, "<u8").tobytes()
        body = struct.pack("<Q", len(self.ids)) + self.zip.compress(columns)
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(body)) + body)
        self.frames.append((len(body) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to one file; holds its directory and one frame."""

    def __init__(self, source):
        self.f, self.size, self.unzip, self.last = source, source.size(), zstandard.ZstdDecompressor(), (-1, b"")
        n, flags, magic = struct.unpack("<IBI", self._at(self.size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("not a seekable file with checksums")
        entries = np.frombuffer(self._at(self.size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self.packed_at = np.concatenate([[0], np.cumsum(self.packed)])
        self.plain_at = np.concatenate([[0], np.cumsum(self.plain)]).tolist()
        body = self._at(int(self.packed_at[n - 1]) + 8, int(self.packed[n - 1]) - 8)
        docs = struct.unpack("<Q", body[:8])[0]
        raw = self.unzip.decompress(body[8:], max_output_size=17 * docs or 1)
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.nulls = np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = self.unzip.decompress(self._at(int(self.packed_at[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
            if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: checksum does not match")
            self.last = (k, data)
        return self.last[1]

    def document(self, i: int) -> bytes:
        """Ids of the file's i-th document, from the frames that hold them and no others."""
        a, b = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        k, out = bisect.bisect_right(self.plain_at, a) - 1, []
        while a < b:
            data, base = self._frame(k), self.plain_at[k]
            out.append(data[a - base : b - base])
            a, k = base + len(data), k + 1
        return b"".join(out)

    def find(self, doc_ids: list[int]) -> list[int]:
        return np.flatnonzero(np.isin(self.ids, doc_ids) & ~self.nulls).tolist()


def writer_uri(uri: str) -> str:
    """The address as pyarrow names it."""
    return re.sub("^s3[an]://", "s3://", uri)


def _open(uri: str):
    return pafs.FileSystem.from_uri(writer_uri(uri))


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files under ``path`` (a URI; by default in the shared folder) and returns
    the committed manifest: shard, part, path, n_docs, n_ids, low and high (smallest and largest
    document id, null where all are null) and base, the ids in files before."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    end = struct.pack("<I", end_id)

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    run_name = f"ids-{uuid.uuid4().hex[:8]}"

    def run(batches):
        e, shard, part, writer, name = encoder(vocabulary), TaskContext.get().partitionId(), 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            low, high = writer.span()
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": f"{path}/{name}", "n_docs": len(writer.counts), "n_ids": writer.n_ids, "low": low, "high": high}], schema)

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), e.encode_all(x.as_py() for x in b.column(1)), strict=True):
                if writer is not None and (len(writer.counts) >= FILE_DOCS or 4 * writer.n_ids >= FILE_BYTES):
                    yield closed()
                    writer, part = None, part + 1
                if writer is None:
                    fs, folder = _open(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"{run_name}-{shard:06d}-{part:05d}-{uuid.uuid4().hex[:8]}.zst"
                    writer = Writer(fs.open_output_stream(f"{folder}/{name}", compression=None))
                writer.add(i, ids + end)
        if writer is not None:
            yield closed()

    order = ["_id", "_h"]
    rows = docs.select(docs[quoted(id_col)].cast("long").alias("_id"), F.coalesce(docs[quoted(text_col)], F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    manifest = materialize(sorted_rows.mapInArrow(run, _MANIFEST), "token-manifest")
    remove_unnamed(manifest, path, run_name)
    # one row for each file, not for each document
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def remove_unnamed(manifest: DataFrame, path: str, run_name: str) -> None:
    """Deletes the run's files that its manifest doesn't name: those of attempts that failed or came second."""
    fs, folder = _open(path)
    named = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()}
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.startswith(run_name) and f.base_name not in named:
            fs.delete_file(f.path)


def read_token_files(manifest: DataFrame, doc_ids: set[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of every document, or of ``doc_ids`` alone, for which
    only the files whose range of ids holds one are opened."""
    asked = None if doc_ids is None else sorted(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                some = asked
                if asked is not None:
                    some = [] if row["low"] is None else asked[bisect.bisect_left(asked, row["low"]) : bisect.bisect_right(asked, row["high"])]
                    if not some:
                        continue
                fs, name = _open(row["path"])
                with fs.open_input_file(name) as source:
                    r, held, size = Reader(source), [], 0
                    for i in range(len(r.counts)) if some is None else r.find(some):
                        ids = r.document(i)
                        held.append((None if r.nulls[i] else int(r.ids[i]), row["base"] + int(r.starts[i]), int(r.counts[i]), ids))
                        size += len(ids)
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("path", "base", "low", "high")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
