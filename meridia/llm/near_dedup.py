"""MinHash near-dedup by a multi-index Hamming join.

1. A text becomes the set of its word shingles (64-bit hashes) and a signature of ``TOTAL``
   symbols of 16 bits, b-bit MinHash. Texts with equal sets are one node.
2. The first symbols are split into ``CHUNKS`` chunks of ``WIDTH``. Two signatures that differ
   in at most ``CHUNKS * (ERRORS + 1) - 1`` of these differ in at most ``ERRORS`` symbols of some chunk
   (pigeonhole). Each node therefore emits, for each chunk, one key for every choice of
   ``ERRORS`` symbols left out: all pairs under that distance share a key, without
   exception. A pair of similarity 0.8 shares none with a probability below 1e-8.
3. In a bucket each member is first compared with the bucket's smallest node alone. Pairs
   whose whole signatures can't belong to the similarity go (distance over ``FAR``, 1e-8 again);
   the others are confirmed on the full sets, made anew from the whole texts.
4. Confirmed links are joined to components by alternating star contraction, each round a
   written table.
5. Buckets that hold several components are compared across components, so that no link
   between them is lost. The members of a bucket's largest component are never compared with
   each other, only with the rest of the bucket. A bucket of over ``LARGE`` members is one of a
   large group of copies; in the first ``DENSE`` slots its members come with their full sets,
   overlaps are counted exactly inside the task, and only links that join two components
   leave it. What is left (small buckets, and the rare pairs of a large group that share
   none of these slots) leaves the task as pairs within the signature distance, each in the
   first slot it shares and in no other, to be confirmed like those of step 3. Both ways end
   in the same test on the same full sets; they differ in what is sent, not in what is found.

Hot buckets: counts and minima are combined on the map side, the join back is a plain
equi-join that Spark can split, and step 5 works on cells of two blocks of ``BLOCK`` members at
most. Copies are never expanded into all pairs.

Defined results: ids are whole numbers (an id column of another type must
hold such, as anything else is an error); texts without words (null, empty, blank) have an empty set and are linked
with nothing, so each such row stays; fewer words than a shingle has make one shingle; null
ids sort after all others; of rows that tie on id and text, one stays, in ``drop_near_duplicates``
the one with the smallest hash of the whole row; an empty table gives an empty result; extra
columns are carried along by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted, row_order, unused

from .scratch import Workspace, bound_batches, materialize

CHUNKS, WIDTH, ERRORS = 14, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: Symbols of a whole signature; those past the chunks only sharpen the distance. And the
#: distance beyond which a pair is not confirmed: at similarity 0.8 one of 25.6 is expected,
#: and one over 53 has a probability below 1e-8.
TOTAL, FAR = 128, 53
#: Members of a block of a bucket and, where they bring full sets, shingles of a block;
#: members of a large bucket; slots that bring full sets.
BLOCK, MASS, LARGE, DENSE = 512, 250_000, 32, 14
_rng = np.random.default_rng(20_240_607)
#: Multipliers and offsets of the hash functions; 32 bits, which processors take several at a time.
_A = _rng.integers(0, 2**31, TOTAL, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, TOTAL, dtype=np.uint32)
_W = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
#: For each slot (left-out symbol and chunk; the first slots are of different chunks, so they
#: are independent), the symbols that remain.
_KEPT = np.array([[c * WIDTH + i for i in range(WIDTH) if i != e] for e in range(WIDTH) for c in range(CHUNKS)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> _S)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words: A-Z in lower case,
    words cut at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    total = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(parts) - k + 1 + i] * _W[i]
    total = np.sort(_mix(total))
    new = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def signature(shingles: np.ndarray) -> np.ndarray:
    low, x = np.full(TOTAL, np.iinfo(np.uint32).max, np.uint32), shingles.astype(np.uint32)
    room = np.empty((min(len(x), 512), TOTAL), np.uint32)  # stays in the processor's cache
    for k in range(0, len(x), 512):
        part = x[k : k + 512, None]
        hashed = np.multiply(part, _A, out=room[: len(part)])
        hashed += _B
        np.minimum(low, hashed.min(axis=0), out=low)
    return (_mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), TOTAL)


def _first_slot(same: np.ndarray) -> np.ndarray:
    """First slot in which signatures agree, from their symbol-wise agreement (rows x SYMBOLS)."""
    chunks = same.reshape(-1, CHUNKS, WIDTH)
    equal = chunks.sum(axis=2)[:, None, :]
    agree = (equal == WIDTH) | ((equal == WIDTH - 1) & ~chunks.transpose(0, 2, 1))
    return agree.reshape(-1, SYMBOLS).argmax(axis=1)


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows of one table apart by id and text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(id_col, text), F.xxhash64(F.lit(1), id_col, text)


_SETS = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def _set_rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """row, key, key2, doc_id, n, digest, sig of every input row; row is unique."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for text in b.column(3):
                s = shingle_set(text.as_py(), words)
                out.append((row, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes() if len(s) else None))
                row += 1
            cols = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(cols[0], pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SETS)

    key, key2 = row_keys(docs[quoted(id_col)], docs[quoted(text_col)])
    rows = docs.select(key.alias("key"), key2.alias("key2"), docs[quoted(id_col)].cast("long").alias("doc_id"), docs[quoted(text_col)].alias("text"))
    return rows.mapInArrow(run, "row long, key long, key2 long, doc_id long, n long, digest binary, sig binary")


def _nodes(sets: DataFrame) -> DataFrame:
    """One row for each distinct non-empty set: node, best (its first row), keys, n, digest, sig."""
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    one = F.min(F.struct(best.alias("best"), "key", "key2", "n", "sig"))
    nodes = sets.filter("n > 0").groupBy("digest").agg(one.alias("x"))
    return nodes.select(F.col("x.best.row").alias("node"), "x.best", "x.key", "x.key2", "x.n", "digest", "x.sig")


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, slot, node): one row for each slot."""
    schema = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("node", pa.int64())])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                s = _symbols(part.column(1)).astype(np.uint64)[:, _KEPT]
                packed = s[..., 0] | s[..., 1] << np.uint64(16) | s[..., 2] << np.uint64(32) | s[..., 3] << np.uint64(48)
                keys = _mix(packed ^ _SLOT).view(np.int64).ravel()
                slots = np.tile(np.arange(SYMBOLS, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(slots), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], schema=schema)

    return nodes.select("node", "sig").mapInArrow(run, "key long, slot int, node long")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, slot, node, low) of buckets with several members; low is the smallest member."""
    keys = _keys(nodes)
    several = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    return keys.join(several, "key")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    side = nodes.select("node", "n", "sig")
    a = side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def run(batches):
        for x in batches:
            keep = (_symbols(x.column(2)) != _symbols(x.column(3))).sum(axis=1) <= FAR if x.num_rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").filter(fit).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


_FULL = pa.schema([("node", pa.int64()), ("set", pa.binary())])
_BATCH_BYTES = 4 << 20


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the nodes, made from the whole texts of their first rows. A node whose
    row repeats may come more than once, from different tasks."""
    ends = wanted.select("node").distinct().join(nodes.select("node", "key", "key2", "digest"), "node")
    key, key2 = row_keys(docs[quoted(id_col)], docs[quoted(text_col)])
    rows = docs.select(key.alias("key"), key2.alias("key2"), docs[quoted(text_col)].alias("text"))

    def run(batches):
        seen, held, size = set(), [], 0
        for b in batches:
            for node, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if node in seen:
                    continue
                blob = shingle_set(text.as_py(), words).tobytes()
                if xxhash.xxh3_128_digest(blob) != digest:
                    continue  # another text with the same keys
                seen.add(node)
                held.append((node, blob))
                size += len(blob)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FULL, strict=True)], schema=_FULL)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FULL, strict=True)], schema=_FULL)

    return ends.join(rows, ["key", "key2"]).select("node", "digest", "text").mapInArrow(run, "node long, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

    def run(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column(2), x.column(3), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def components(links: DataFrame, keep=materialize) -> DataFrame:
    """(node, comp): smallest node reachable, for every node with a link. Alternating large
    and small stars; each round is written, so a lost executor costs one round at most. Done
    when all is stars: no centre has an edge to a smaller node."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = keep(large.unionByName(low.filter("u > m").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("s")).unionByName(edges.select(F.col("v").alias("node"), F.lit(2).alias("s")))
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if sides.groupBy("node").agg(F.bit_or("s").alias("s")).filter("s = 3").isEmpty() and twice.isEmpty():
            break
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(heads)


def _overlap_links(sets: list[np.ndarray], comp: np.ndarray, minor: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join two components, few enough to join all that are
    linked; one of the two is ``minor``. Overlaps with all others are counted through the
    members of each shingle."""
    n = np.array([len(s) for s in sets])
    shingle, index = np.unique(np.concatenate(sets), return_inverse=True)
    index = index.astype(np.int32)
    order = np.argsort(index, kind="stable")
    members = np.repeat(np.arange(len(sets), dtype=np.int32), n)[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=len(shingle)))])
    del order, shingle
    ends = np.cumsum(n)
    root, out = comp.copy(), []
    for x in np.flatnonzero(minor).tolist():
        if (root == root[x]).all():
            continue
        mine = index[ends[x] - n[x] : ends[x]]
        both = np.zeros(len(sets), np.int64)
        for k in range(0, len(mine), 1024):  # so many members at once as a few blocks have
            a, size = starts[mine[k : k + 1024]], starts[mine[k : k + 1024] + 1] - starts[mine[k : k + 1024]]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both += np.bincount(members[at], minlength=len(sets))
        for y in np.flatnonzero(100 * both >= percent * (n + n[x] - both)):
            if root[y] != root[x]:
                out.append((x, int(y)))
                root[root == root[y]] = root[x]
    return out


def _block_pairs(table: pa.Table, percent: int) -> np.ndarray:
    """Pairs (a, b) of different components in each run of rows of one block, within the
    signature distance, each in the first slot it shares. All blocks of the table are
    compared at once: row i with row i + 1, then with row i + 2, to the block's end."""
    node, comp, n, slot, ends = (table[c].to_numpy() for c in ("node", "comp", "n", "slot", "end"))
    sig, out = _symbols(table["sig"].combine_chunks()), [np.empty((2, 0), np.int64)]
    left, step = np.arange(len(node)), 1
    while len(left := left[left + step < ends[left]]):
        x, y = left, left + step
        fit = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        if len(x):
            same = sig[x] == sig[y]
            fit = TOTAL - same.sum(axis=1) <= FAR
            x, y, same = x[fit], y[fit], same[fit, :SYMBOLS]
            fit = _first_slot(same) == slot[x]
            x, y = node[x[fit]], node[y[fit]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        step += 1
    return np.concatenate(out, axis=1)


def _near_in_blocks(batches, percent: int):
    """Batches of pairs from rows sorted by block; a block that goes on in the next batch waits
    for it, so the rows held are one batch and one block, which ``BLOCK`` bounds."""

    def pairs(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], table.num_rows)
        found = _block_pairs(table.append_column("end", pa.array(np.repeat(ends, ends - starts))), percent)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    held, starts = None, np.zeros(1, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        first = np.ones(held.num_rows, bool)
        first[1:] = np.any([held[c].to_numpy()[1:] != held[c].to_numpy()[:-1] for c in _CELL], axis=0)
        starts = np.flatnonzero(first)
        if len(starts) > 1:
            last = int(starts[-1])
            yield pairs(held.slice(0, last), starts[:-1])
            held, starts = held.slice(last), np.zeros(1, np.int64)
    if held is not None:
        yield pairs(held, starts)


def _cells(buckets: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, slot, dense, part, i, j, node, comp, n, minor): members of buckets that hold several
    components, dealt to cells so that any two of different components meet in one. Minor
    members are those outside the bucket's largest component. Cell (0, i, j) holds blocks i
    and j of the minor ones, cell (1, i, j) block i of these and block j of the others."""
    at = buckets.select("key", "slot", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(nodes.select("node", "n"), "node")
    one = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"))
    largest = F.max(F.struct("m", "comp", "mass")).alias("x")
    facts = one.groupBy("key").agg(largest, F.sum("m").alias("m"), F.sum("mass").alias("mass")).filter("x.m < m")
    dense = (F.col("m") > LARGE) & (F.col("slot") < DENSE)
    blocks = lambda m, mass: F.greatest(F.ceil(m / F.lit(float(BLOCK))), F.when(dense, F.ceil(mass / F.lit(float(MASS)))).otherwise(1)).cast("int")
    mixed = facts.select("key", "m", F.col("x.comp").alias("top"), (F.col("m") - F.col("x.m")).alias("m0"), (F.col("mass") - F.col("x.mass")).alias("mass0"), F.col("x.m").alias("m1"), F.col("x.mass").alias("mass1"))
    members = at.join(mixed, "key").withColumns({"minor": F.col("comp") != F.col("top"), "dense": dense, "b0": blocks(F.col("m0"), F.col("mass0")), "b1": blocks(F.col("m1"), F.col("mass1"))})
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("b0")).otherwise(F.col("b1"))).cast("int")
    # a minor member goes to all pairs of minor blocks that hold its own, and to its row of the others
    upto = lambda b: F.sequence(F.lit(0), F.col(b) - 1)
    cell = lambda part, i, j: F.struct(F.lit(part).alias("part"), i.alias("i"), j.alias("j"))
    with_minor = F.transform(upto("b0"), lambda k: cell(0, F.least(F.col("mine"), k), F.greatest(F.col("mine"), k)))
    with_others = F.transform(upto("b1"), lambda k: cell(1, F.col("mine"), k))
    other = F.transform(upto("b0"), lambda k: cell(1, k, F.col("mine")))
    dealt = members.withColumn("mine", mine).withColumn("cell", F.explode(F.when(F.col("minor"), F.concat(with_minor, with_others)).otherwise(other)))
    return dealt.select("key", "slot", "dense", "cell.part", "cell.i", "cell.j", "node", "comp", "n", "minor")


_CELL = ["key", "slot", "part", "i", "j"]


def _across(dealt: DataFrame, nodes: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) across components from the cells: links confirmed inside large buckets,
    and pairs within the signature distance that are still to be confirmed."""

    def exact(table: pa.Table) -> pa.Table:
        node, comp, minor = (table[c].to_numpy() for c in ("node", "comp", "minor"))
        found = _overlap_links([np.frombuffer(x.as_py(), np.uint64) for x in table["set"]], comp, minor, percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    # small in bytes and large in work: dealt to all partitions, not gathered by size
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.filter("dense").join(full, "node").select(*_CELL, "node", "comp", "minor", "set").repartition(parts, *_CELL).groupBy(*_CELL).applyInArrow(exact, "a long, b long").distinct()

    rest = dealt.filter("NOT dense").join(nodes.select("node", "sig"), "node").repartition(parts, *_CELL).sortWithinPartitions(*_CELL)
    return links, rest.select(*_CELL, "node", "comp", "n", "sig").mapInArrow(lambda batches: _near_in_blocks(batches, percent), "a long, b long").distinct()


def _contracted(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between nodes as links between their components."""
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("c_a"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("c_b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    return ends.filter("a <> b").distinct()


def _labelled(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """row, keys, doc_id, n and best, the first row of the component, of every input row: a
    written table."""
    bound_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "near")
    sets = work.keep(_set_rows(docs, words, id_col, text_col), "sets")
    nodes = work.keep(_nodes(sets), "nodes")
    buckets = work.keep(_buckets(nodes), "buckets")
    stars = buckets.filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    near = work.keep(_near(stars, nodes, percent), "stars")
    full = work.keep(_full_sets(buckets, nodes, docs, words, id_col, text_col), "full-sets")
    links = work.keep(_confirm(near, full, percent), "links")
    comps = work.keep(components(links, work.keep), "components")
    exact, pairs = _across(work.keep(_cells(buckets, comps, nodes), "cells"), nodes, full, percent)
    more, pairs = work.keep(exact, "exact"), work.keep(pairs, "across")
    if not pairs.isEmpty():
        more = more.unionByName(_confirm(pairs, full, percent))
    more = work.keep(_contracted(more, comps), "merges")
    if not more.isEmpty():
        merged = components(more, work.keep).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
        every = comps.unionByName(_ends(more).distinct().withColumn("comp", F.col("node"))).distinct()
        comps = work.keep(every.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "components")
    best = comps.join(nodes.select("node", "best"), "node")
    heads = best.groupBy("comp").agg(F.min("best").alias("head"))
    heads = comps.join(heads, "comp").select("node", "head")
    of_set = nodes.join(heads, "node", "left").select("digest", F.coalesce("head", "best").alias("best"))
    full = sets.filter("n > 0").select("row", "key", "key2", "doc_id", "n", "digest").join(of_set, "digest").drop("digest")
    itself = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    out = materialize(full.unionByName(sets.filter("n = 0").select("row", "key", "key2", "doc_id", "n", itself.alias("best"))), "near-marks")
    work.drop()
    return out


def mark_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    out = _labelled(docs, words, percent, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns, and every row without words.

    Rows that repeat an id and its text are cut to one before the join, on the map side too,
    so that no such group is gathered whole."""
    marks = _labelled(docs, words, percent, id_col, text_col)
    own = unused(docs.columns, "_key", "_key2", "_order", "_n")
    key, key2, order, n = own
    kept = marks.filter("n > 0 AND row = best.row").select(F.col("key").alias(key), F.col("key2").alias(key2)).distinct()
    text = docs[quoted(text_col)]
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    ids = row_keys(docs[quoted(id_col)], text)
    first = F.row_number().over(Window.partitionBy(key, key2).orderBy(order))
    keyed = docs.filter(~wordless).withColumns({key: ids[0], key2: ids[1], order: row_order(docs)})
    once = keyed.withColumn(n, first).filter(F.col(n) == 1).join(kept, [key, key2], "left_semi")
    columns = [quoted(c) for c in docs.columns]
    return once.select(*columns).unionByName(docs.filter(wordless).select(*columns))
