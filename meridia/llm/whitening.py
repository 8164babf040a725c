"""Whitening of embeddings by a tiled covariance.

1. The vectors that take part are written once. Entries become integers: floor(1024 c) + 100000.
2. Sums of each dimension (map-side combined) give the mean, rounded to an integer, as centre.
3. Rows are cut into row blocks and the centred entries of each into column blocks of ``TILE``
   dimensions, in the smallest integer type that holds them. Column blocks are shuffled by row
   block, so the task that gets a row block multiplies all its pairs of column blocks: each
   pair of dimension blocks is a tile, whose products are summed in the task, then over tasks.
4. The tiles (dimensions squared, whatever the number of rows) are assembled at the driver. All
   sums are exact integers, so a covariance is exact until its one rounding to a double.
5. Eigenvectors of the covariance are the components. Where eigenvalues differ by so much that
   the small ones would drown in the rounding of the large, Jacobi rotations find them instead,
   which keep the relative accuracy of covariances whose dimensions have unlike scales.
6. One scan projects all rows; a scan before it measures the covariance of what comes out.

Nothing that reaches the driver or a closure grows with the rows: it is squares of vector lengths,
of at most ``LENGTHS`` lengths at a time.

Defined results: vectors that are null, or hold null or non-finite entries, or an entry of 2^52 or
more in size (its integer is near the end of 64 bits), take no part. Vectors of another length are a space of their own,
with a fit of their own; vectors without entries have no components and give no row. Repeated
rows and ids are rows like any other. A component without variance (all vectors alike, or
fewer vectors than components) has explained 0 and whitened null, as nothing can be scaled to 1. A
deviation of over 38 digits is null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.names import quoted

from .scratch import bound_batches, materialize

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Dimensions of a column block; rows and bytes of a row block at most; lengths fitted at a time.
TILE, BLOCK_ROWS, BLOCK_BYTES, LENGTHS = 16, 4096, 4 << 20, 64
#: Bits of a limb: 4096 products of two limbs add up below 2^53, so doubles hold them exactly.
LIMB = 20
#: Eigenvalues below this share of the largest are found by Jacobi rotations.
GRADED = 1e-6
#: First-level groups in which the tasks' tiles are summed.
FAN_IN = 64


def usable(vector: Column) -> Column:
    """Whether all entries are there, finite, and well within 64 bits as integers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(2.0**52)))


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) of a batch's column of lists without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a transposed times b in whole numbers, for up to 4096 rows of 64-bit integers."""

    def limbs(x: np.ndarray) -> list[np.ndarray]:
        out = []
        while len(x) and (x.min() < -(1 << LIMB) or x.max() > 1 << LIMB):
            out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
            x = x >> LIMB
        return [*out, x.astype(np.float64)]

    la, lb = limbs(a), limbs(b)
    if len(la) == len(lb) == 1:
        return (la[0].T @ lb[0]).astype(np.int64)
    total = np.zeros((a.shape[1], b.shape[1]), object)
    for p, x in enumerate(la):
        for q, y in enumerate(lb):
            total += (x.T @ y).astype(np.int64).astype(object) * (1 << (LIMB * (p + q)))
    return total


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of any size as bytes: 64-bit where they fit, else decimal text."""
    flat = values.astype(object).ravel()
    if all(-(1 << 62) < v < 1 << 62 for v in flat):
        return b"q" + flat.astype(np.int64).tobytes()
    return b"t" + ",".join(map(str, flat)).encode()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"q":
        return np.frombuffer(data, np.int64, offset=1).astype(object)
    return np.array([int(v) for v in data[1:].split(b",")], object)


@dataclass
class Fit:
    """Vectors of one length: their number, their centre and what sums exceed n times it by."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; not a number where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (self.centred(x) @ self.axes) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over the dimensions of (n x - S)^2, in whole numbers."""
        d, most = x - self.centre, [abs(r) for r in self.rest]
        top, high, n = max(1, int(np.abs(d).max(initial=0))), max(most, default=0), self.n
        if len(most) * (n * top + high) ** 2 < 1 << 62:
            return ((n * d - np.array(self.rest, np.int64)) ** 2).sum(axis=1)
        if len(most) * top * max(top, high) < 1 << 62:
            squares, crossed = (d * d).sum(axis=1), d @ np.array(self.rest, np.int64)
        else:
            wide = d.astype(object)
            squares, crossed = (wide * wide).sum(axis=1), wide @ np.array(self.rest, object)
        own = sum(r * r for r in self.rest)
        return [n * n * int(s) - 2 * n * int(c) + own for s, c in zip(squares, crossed, strict=True)]


def jacobi(v: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) by cyclic rotations, until no entry off the
    diagonal is above rounding beside its two diagonal ones."""
    a, axes, d = v.copy(), np.eye(len(v)), len(v)
    for _ in range(sweeps):
        still = True
        for p in range(d - 1):
            for q in range(p + 1, d):
                if a[p, q] * a[p, q] <= 1e-32 * abs(a[p, p] * a[q, q]):
                    continue
                still = False
                tau = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.copysign(1, tau) / (abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s, app, aqq, apq = t * c, a[p, p], a[q, q], a[p, q]
                for m in (a, a.T, axes):  # columns, rows (of a symmetric matrix), vectors
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
        if still:
            break
    return np.diag(a).copy(), axes


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, share of the trace) of the k largest. Each
    vector's largest entry is positive. Eigenvalues that are nothing but rounding are 0."""
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    if values[order[-1]] < GRADED * values[order[0]]:
        values, axes = jacobi(v)
        order = np.argsort(-values, kind="stable")[:k]
    # an eigenvalue is rounding if it is so beside the variances that its axis is made of
    parts = (axes**2 * np.diag(v)[:, None]).sum(axis=0)
    values = np.where(values > 1e-13 * len(v) * parts, values, 0.0)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values[order], axes[:, order], values[order] / max(np.trace(v), np.finfo(float).tiny)


def _sums(vectors: DataFrame) -> DataFrame:
    """(length, dim, n, s) over all vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, _, found in by_length(batch.column(0)):
                x = integers(found)
                near = len(x) * int(np.abs(x).max()) < 1 << 62
                n, s = total.get(d, (0, np.zeros(d, object)))
                total[d] = (n + len(x), s + (x if near else x.astype(object)).sum(axis=0).astype(object))
        for d, (n, s) in total.items():
            yield pa.record_batch(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(s), pa.decimal128(38, 0))], ["length", "dim", "n", "s"]
            )

    found = vectors.select("v").mapInArrow(run, "length int, dim int, n long, s decimal(38,0)")
    return found.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def centres(vectors: DataFrame) -> dict[int, Fit]:
    """For each length its number of vectors, its centre and the rests of the sums."""
    held: dict[int, list] = defaultdict(list)
    for r in _sums(vectors).collect():  # a row for each dimension of each length
        held[r["length"]].append((r["dim"], r["n"], int(r["s"])))
    out = {}
    for d, rows in sorted(held.items()):
        n, sums = rows[0][1], [s for _, _, s in sorted(rows)]
        centre = [(2 * s + n) // (2 * n) for s in sums]
        out[d] = Fit(n, np.array(centre, np.int64), [s - n * c for s, c in zip(sums, centre, strict=True)])
    return out


def column_blocks(vectors: DataFrame, fits: dict[int, Fit], tile: int) -> DataFrame:
    """(block, length, col, kind, data): the centred entries of each row block by column block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, _, found in by_length(batch.column(0)):
                if d not in fits:
                    continue
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
                for at in range(0, len(found), step):
                    x = integers(found[at : at + step]) - fits[d].centre
                    for col, first in enumerate(range(0, d, tile)):
                        part = x[:, first : first + tile]
                        kind = np.min_scalar_type(-1 - int(np.abs(part).max()))  # signed, as it is below 0
                        for held, value in zip(out, (block, d, col, kind.str, np.ascontiguousarray(part, kind).tobytes()), strict=True):
                            held.append(value)
                    block += 1
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["block", "length", "col", "kind", "data"])

    return vectors.select("v").mapInArrow(run, "block long, length int, col int, kind string, data binary")


def tile_sums(blocks: DataFrame, tile: int) -> DataFrame:
    """(length, i, j, data): for each pair of column blocks the sum over all row blocks of
    one's transpose times the other. Row blocks are shuffled once, whole."""

    def width(d: int, col: int) -> int:
        return min(tile, d - col * tile)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        now, length = None, 0

        def multiply() -> None:
            for i, a in enumerate(held):
                for j in range(i, len(held)):
                    found = exact_product(a, held[j]).astype(object)
                    total[length, i, j] = found + total[length, i, j] if (length, i, j) in total else found

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    multiply()
                    held, now, length = [], r["block"], r["length"]
                held.append(np.frombuffer(r["data"], np.dtype(r["kind"])).reshape(-1, width(length, r["col"])).astype(np.int64))
        multiply()
        slot = TaskContext.get().partitionId() % FAN_IN
        for (d, i, j), found in total.items():
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([slot], pa.int32()), pa.array([packed(found)], pa.binary())], ["length", "i", "j", "slot", "data"])

    def add(rows: pa.Table) -> pa.Table:
        data = rows.column("data")
        total = unpacked(data[0].as_py())
        for k in range(1, len(data)):
            total = total + unpacked(data[k].as_py())
        return rows.slice(0, 1).set_column(rows.column_names.index("data"), "data", pa.array([packed(total)], pa.binary()))

    schema = "length int, i int, j int, slot int, data binary"
    parts = blocks.repartition("block").sortWithinPartitions("block", "col").mapInArrow(run, schema)
    # in two levels: a task adds up no more than its share of all tasks' tiles
    parts = parts.groupBy("length", "i", "j", "slot").applyInArrow(add, schema)
    return parts.groupBy("length", "i", "j").applyInArrow(add, schema).drop("slot")


def covariance(n: int, rest: list[int], tiles: dict[tuple[int, int], np.ndarray], tile: int) -> np.ndarray:
    """The covariance (divisor n) from tile sums of entries centred at a whole number: exact in
    whole numbers, rounded once."""
    d = len(rest)
    v = np.zeros((d, d))
    for (i, j), data in tiles.items():
        wide = min(tile, d - j * tile)
        for at, m in enumerate(data):
            a, b = i * tile + at // wide, j * tile + at % wide
            v[a, b] = v[b, a] = (n * m - rest[a] * rest[b]) / (n * n)
    return v


def fit(vectors: DataFrame, fits: dict[int, Fit], k: int, tile: int) -> None:
    """Adds eigenvalues, axes and shares to the fits of some lengths."""
    tiles: dict[int, dict] = defaultdict(dict)
    for r in tile_sums(column_blocks(vectors, fits, tile), tile).collect():  # squares of the lengths
        tiles[r["length"]][r["i"], r["j"]] = unpacked(bytes(r["data"]))
    for d, one in fits.items():
        one.values, one.axes, one.explained = components(covariance(one.n, one.rest, tiles[d], tile), min(k, d))


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened rows' covariance minus the
    identity, over the components that have variance."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, found in by_length(batch.column(0)):
                if d in fits:
                    w = fits[d].whitened(integers(found))[:, fits[d].values > 0]
                    total[d] = total.get(d, 0) + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        for d, found in total.items():
            yield pa.record_batch([pa.array([d] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.float64())], ["length", "at", "s"])

    out: dict[int, dict] = defaultdict(dict)
    for r in vectors.select("v").mapInArrow(run, "length int, at int, s double").groupBy("length", "at").agg(F.sum("s").alias("s")).collect():
        out[r["length"]][r["at"]] = r["s"]
    errors = {}
    for d, one in fits.items():
        k = int((one.values > 0).sum())
        s = np.array([out[d][at] for at in range(k + k * k)]) / one.n
        errors[d] = float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max(initial=0.0))
    return errors


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """One row for each vector that takes part and component, up to ``components``: id,
    component, n, deviation (decimal), whitened, explained, identity_error, length."""
    spark = table.sparkSession
    bound_batches(spark)
    vector = table[quoted(vector_col)]
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    given = table.filter(usable(vector)).select(table[quoted(id_col)].alias("id"), vector.cast(kind).alias("v"))
    vectors = materialize(given, "vectors")
    schema = T.StructType([T.StructField(id_col, table.schema[id_col].dataType)] + T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, length int").fields)
    fits, found = centres(vectors), None
    lengths = sorted(fits)
    for at in range(0, len(lengths), LENGTHS):
        some = {d: fits[d] for d in lengths[at : at + LENGTHS]}
        fit(vectors, some, components, tile)
        part = _projected(vectors, some, identity_errors(vectors, some), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _projected(vectors: DataFrame, fits: dict[int, Fit], errors: dict[int, float], schema: T.StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, found in by_length(batch.column(1)):
                if d not in fits:
                    continue
                one, x = fits[d], integers(found)
                w, dev, k = one.whitened(x), one.deviations(x), len(one.values)
                held = pa.array(dev).cast(pa.decimal128(38, 0)) if isinstance(dev, np.ndarray) else pa.array([v if v < 10**38 else None for v in dev], pa.decimal128(38, 0))
                m = len(rows) * k
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(m, one.n)), held.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(one.explained, len(rows))),
                        pa.array(np.full(m, errors[d])), pa.array(np.full(m, d, np.int32)),
                    ],
                    names,
                )

    return vectors.select("id", "v").mapInArrow(run, schema)
