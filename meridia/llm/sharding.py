"""Sharding by a two-pass external shuffle.

1. Every record is scattered to one of B buckets by a seeded hash of its number in the input. B
   follows from the bytes of all records, so that a bucket fits in a worker's memory; as the
   hash is of the record's number and never of its key or text, copies and records of one
   source spread like any other.
2. Each bucket is one task: its records are put in the order of their numbers (whatever order
   the shuffle delivered them in), shuffled by Fisher-Yates with a generator seeded by seed
   and bucket, and written. The order of all records is that of the buckets, one after the other.

Shards are ranges of that order, so their numbers of records are at most one apart (law ``rows``).
Bucket sizes are counted from the written files, which name each record's bucket and place;
a record's place in the order is its place plus the records of all earlier buckets. At most
``MAX_BUCKETS`` rows of (bucket, first) are broadcast for that: 16 bytes each.

Nothing is held in memory but one bucket for each worker. A lost task is one bucket, made again
from the scattered files with the same order. The same input files and settings give the same
shards; other seeds give others.

Defined results: null texts are kept as null and have no bytes; empty texts, null ids, repeated
rows and equal texts are records like any other, nothing holds them together or apart. A table
with fewer records than shards leaves some shards empty; an empty table gives no records.
Extra columns go along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.names import quoted, unused

from .scratch import BATCH_BYTES, bound_batches

SHARDS, SEED = 40, 20240607
#: Bytes of a bucket on average; buckets at least (for small tables) and at most.
BUCKET, MIN_BUCKETS, MAX_BUCKETS = 16 << 20, 16, 1 << 21
#: Bytes that a record has beside its text.
RECORD = 16
#: Buckets whose rows one window adds up.
SPAN = 1024
LAW = "rows"


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD).cast("long")


def bucket_count(docs: DataFrame) -> int:
    """Buckets for a table, by the bytes of its texts and binaries; bounded."""
    sizes = [F.coalesce(F.octet_length(docs[quoted(f.name)]), F.lit(0)) for f in docs.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    whole = docs.agg(F.sum(sum(sizes, F.lit(RECORD)).cast("long"))).scalar()
    total = docs.sparkSession.range(1).select(whole).first()[0] or 0
    return max(MIN_BUCKETS, min(MAX_BUCKETS, -(-total // BUCKET)))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n, from a generator of seed and bucket."""
    draw = np.random.default_rng([seed, bucket])
    order = list(range(n))
    picks = draw.integers(0, np.arange(n, 0, -1)) if n else []  # one below each bound n, n - 1, ..., 1
    for i, j in zip(range(n - 1, -1, -1), picks, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(rows: DataFrame, bucket: str, order: str, seed: int, schema: T.StructType) -> DataFrame:
    """Rows of each bucket in their shuffled order, with their place."""
    names = schema.names

    def emit(held: list[pa.RecordBatch], now: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        n = table.num_rows
        step = max(1, n * BATCH_BYTES // max(1, table.nbytes))
        perm = fisher_yates(n, seed, now)
        for at in range(0, n, step):
            some = table.take(pa.array(perm[at : at + step])).combine_chunks()
            place = pa.array(np.arange(at, at + some.num_rows, dtype=np.int64))
            for batch in some.append_column("place", place).to_batches():
                yield pa.record_batch(batch.columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and of[a] != now:
                    if held:
                        yield from emit(held, now)
                    held, now = [], int(of[a])
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held, now)

    return rows.sortWithinPartitions(bucket, order).drop(order).mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, seed: int = SEED) -> str:
    """Writes all records in shuffled order below ``path`` and returns it: ``records`` with all
    columns, bucket and place, a file for each bucket; ``buckets`` (bucket, rows, first)."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = bucket_count(docs)
    bucket, order, place = unused(docs.columns, "_bucket", "_order", "_place")
    numbered = docs.withColumn(order, F.monotonically_increasing_id())
    scattered = numbered.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.lit(n)).cast("int"))
    schema = T.StructType([*scattered.drop(order).schema.fields, T.StructField(place, T.LongType())])
    _shuffled(scattered.repartitionById(n, F.col(bucket)), bucket, order, seed, schema).write.parquet(f"{path}/records")
    counts = spark.read.parquet(f"{path}/records").groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    spans = counts.withColumn("span", F.floor(F.col("bucket") / SPAN))
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = spans.groupBy("span").agg(F.sum("rows").alias("rows")).select("span", before(Window.orderBy("span")).alias("base"))
    first = spans.withColumn("in", before(Window.partitionBy("span").orderBy("bucket"))).join(bases, "span")
    first.select("bucket", "rows", (F.col("base") + F.col("in")).alias("first")).coalesce(1).write.parquet(f"{path}/buckets")
    return path


def read_shards(spark: SparkSession, path: str, shards: int = SHARDS, shard: int | None = None) -> DataFrame:
    """The records with shard and slot, of all shards or of one. A record at position p of N is in
    shard floor(p shards / N), so shards are ranges whose sizes are at most one apart. Of one
    shard only the buckets that it overlaps are read. Columns ``shard`` and ``slot`` of the records
    give way to these."""
    records, buckets = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/buckets")
    bucket, place = records.columns[-2:]
    known = [c for c in records.columns[:-2] if c.lower() not in ("shard", "slot")]
    total = buckets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    firsts, at, of, shard_ = unused([*records.columns, "shard", "slot"], "_first", "_at", "_of", "_shard")
    if shard is not None:
        low, high = -(-shard * total // shards), -(-(shard + 1) * total // shards)
        own = buckets.filter((F.col("first") < high) & (F.col("first") + F.col("rows") > low)).agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).first()
        records = records.filter(F.col(quoted(bucket)).between(own["a"], own["z"])) if own["a"] is not None else records.limit(0)
    offsets = buckets.select(F.col("bucket").alias(of), F.col("first").alias(firsts))
    placed = records.join(F.broadcast(offsets), F.col(quoted(bucket)) == F.col(of)).withColumn(at, F.col(firsts) + F.col(quoted(place)))
    number = F.expr(f"`{at}` * {shards}L div {max(1, total)}L")
    slot = F.expr(f"`{at}` - (`{shard_}` * {total}L + {shards - 1}L) div {shards}L")
    found = placed.withColumn(shard_, number).select(*map(quoted, known), F.col(shard_).cast("int").alias("shard"), slot.alias("slot"))
    return found if shard is None else found.filter(F.col("shard") == shard)
