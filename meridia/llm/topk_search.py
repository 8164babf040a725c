"""Exact top-k inner products by pivot-table elimination.

1. Pivots are chosen from a sample of at most ``SAMPLE`` vectors, each farthest from the flat
   through those chosen before. Every vector keeps its distances to all pivots: the pivot
   table.
2. The distances to all pivots fix a vector but for its part beyond the pivots' flat, of
   which they fix the length. So of all vectors with these distances the largest inner
   product with a query is known: the inner product of the parts in the flat plus the
   product of the lengths beyond it. No bound that rests on these distances is tighter.
3. Vectors are dealt to blocks by their nearest pivot, queries to groups likewise, both of
   bounded size. Each block and group keeps the range of each number of its bounds. A pair of
   group and block whose ranges can't reach the group's smallest k-th score at hand goes
   before anything is shuffled.
4. In a block the vectors are taken in the order of their upper bound, until the next bound
   is below the k-th score at hand; then nothing left can enter, and the search is exact. It
   starts from the k-th score among the sample, so most vectors are eliminated unseen.
5. The k best of each block are merged for each query.

Only the sample and the pivots (bounded) reach the driver and every task. All arithmetic on
scores is in integers; bounds carry a slack well above their rounding. On vectors without any
structure (independent components) no pair of step 3 can go, and what step 4 scores depends
on the pivots per dimension.

Defined results: ids are whole numbers (an id column of another type must
hold such, as anything else is an error); vectors that are null, or hold null or non-finite components, and rows
without vec_id take no part. Vectors are compared with those of equal length only. A query
is kept from its own row, not from rows that repeat its id; each row with a query's id is a
query. Fewer candidates than k are all returned. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted

from .scratch import bound_batches, materialize

K, SAMPLE, PIVOTS = 5, 2000, 48
#: Bytes of the vectors of a block and of the queries of a group, on average: from, and up to for
#: large tables; vectors scored at once.
BLOCK, GROUP, STEP = (4 << 20, 32 << 20), (1 << 20, 8 << 20), 64


def quantized(embedding: Column) -> Column:
    """floor(256 x) of each component, or null for vectors that take no part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


class Pivots:
    """Pivots of vectors of one length, and what follows from distances to them."""

    def __init__(self, vectors: np.ndarray, n: int = PIVOTS):
        x = vectors.astype(float)
        at = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        chosen, rest, basis = [at], x - x[at], []
        far = (rest**2).sum(axis=1)
        least = 1e-6 * float(far.max(initial=0))
        while len(chosen) < min(n, len(x), x.shape[1] + 1) and far.max() > least:
            at = int(far.argmax())
            chosen.append(at)
            basis.append(rest[at] / np.sqrt(far[at]))
            rest = rest - np.outer(rest @ basis[-1], basis[-1])
            far = (rest**2).sum(axis=1)
        self.points = x[chosen]
        self.origin = self.points[0]
        self.squared = (self.points**2).sum(axis=1)
        # inner products with the edges from the origin pivot to components in the flat
        edges, flat = self.points[1:] - self.origin, np.array(basis).reshape(len(basis), x.shape[1])
        self.solve = np.linalg.inv(edges @ flat.T) if basis else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table's rows of vectors."""
        x = x.astype(float)
        squared = np.stack([((x - p) ** 2).sum(axis=1) for p in self.points], axis=1)
        return np.sqrt(squared)

    def facts(self, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """From distances and squared norms: the part in the flat, the length beyond it, and the
        inner product with the origin pivot."""
        squared = far * far
        along = (norms[:, None] + self.squared - squared) / 2  # inner products with the pivots
        edges = along[:, 1:] - along[:, :1] - (self.points[1:] @ self.origin - self.squared[0])
        flat = edges @ self.solve.T
        beyond = np.sqrt(np.maximum(0, squared[:, 0] - (flat**2).sum(axis=1)))
        return np.concatenate([flat, beyond[:, None], along[:, :1]], axis=1)

    def bounds(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of queries (rows) and vectors (columns)."""
        flat = queries[:, :-1] @ vectors[:, :-1].T
        return flat + (queries[:, -1:] - self.squared[0]) + vectors[:, -1]

    def range_bound(self, low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> float:
        """The largest bound of any query and vector whose facts lie in these ranges."""
        four = np.stack([low * low2, low * high2, high * low2, high * high2]).max(axis=0)
        return float(four[:-1].sum() + high[-1] + high2[-1] - self.squared[0])


def _slack(qq: np.ndarray | float, norms: np.ndarray | float, pivots: Pivots) -> np.ndarray | float:
    return 1e-8 * (qq + norms + pivots.squared[0]) + 1


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of x's rows with q."""
    big = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * max(1, len(q))
    return (x.astype(float) @ q.astype(float)).astype(np.int64) if big < 2**52 else x @ q


def search_block(q: np.ndarray, bound: np.ndarray, floor: float, own: int, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of at most k vectors of the block that may be among the query's best."""
    left = np.flatnonzero((bound >= floor) & (rows != own))
    left = left[np.argsort(-bound[left], kind="stable")]
    best: list[tuple[int, int]] = []
    for a in range(0, len(left), STEP):
        part = left[a : a + STEP]
        if len(best) == k and bound[part[0]] < best[-1][0]:
            break
        got = zip((-_scores(q, x[part])).tolist(), ids[part].tolist(), strict=True)
        best = [(-s, i) for s, i in sorted([*((-s, i) for s, i in best), *got])[:k]]
    return best


_TABLE = "row long, id long, q boolean, size int, cell int, v binary, far binary, floor double"
_RANGES = "size int, block long, low binary, high binary, norm double, floor double"


def _matrix(column: pa.ChunkedArray, n: int, kind=float) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest inner products."""
    bound_batches(table.sparkSession)
    good = table.select(table[quoted(id_col)].cast("long").alias("id"), quantized(table[quoted(vector_col)]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = good.filter("id IS NOT NULL AND v IS NOT NULL")
    some = [r["v"] for r in good.orderBy(F.xxhash64("id", "v")).limit(sample).select("v").collect()]
    tried = {n: np.array([v for v in some if len(v) == n], np.int64) for n in {len(v) for v in some} if n}
    pivots = {n: Pivots(x) for n, x in tried.items()}

    def tabulate(batches):
        for b in batches:
            rows, ids, vs, qs = (b.column(c).to_pylist() for c in range(4))
            lengths = np.array([len(v) for v in vs])
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size).tolist()
                x = np.array([vs[i] for i in at], np.int64).reshape(len(at), size)
                p = pivots.get(size)  # a length that the sample lacks is rare: one cell, scored whole
                far = p.distances(x) if p else np.zeros((len(at), 0))
                floors = [None] * len(at)
                for j, i in enumerate(at):
                    if qs[i] and p and len(tried[size]) > k:  # one more than k: the query itself may be in the sample
                        floors[j] = float(np.sort(_scores(x[j], tried[size]))[-k - 1])
                cells = far.argmin(axis=1) if p else np.zeros(len(at))
                cols = [
                    pa.array([rows[i] for i in at], pa.int64()), pa.array([ids[i] for i in at], pa.int64()), pa.array([qs[i] for i in at], pa.bool_()), pa.array([size] * len(at), pa.int32()),
                    pa.array(cells.astype(np.int32)), pa.array([y.tobytes() for y in x], pa.binary()), pa.array([y.tobytes() for y in far], pa.binary()), pa.array(floors, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "q", "size", "cell", "v", "far", "floor"])

    numbered = good.select(F.monotonically_increasing_id().alias("row"), "id", "v", "q")
    vectors = materialize(numbered.mapInArrow(tabulate, _TABLE), "pivot-table")
    counts = vectors.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("m")).collect()  # a row for each pivot

    def dealt(count: str, limits: tuple[int, int], spread: int) -> Column:
        """Block numbers: a large cell is several blocks, small ones of one length share one."""
        room = {(r["size"], r["cell"]): r[count] * max(1, r["size"]) * 8 for r in counts}
        most = min(limits[1], max(limits[0], sum(room.values()) // spread))
        out, first, last, filled = F.lit(0), 0, None, 0
        for size, cell in sorted(room):
            n, here = -(-room[size, cell] // most), (F.col("size") == size) & (F.col("cell") == cell)
            if n <= 1 and last == size and filled + room[size, cell] <= most:
                number = F.lit(first - 1)
                filled += room[size, cell]
            else:
                n = max(1, n)
                number = F.pmod(F.xxhash64("row"), F.lit(n)) + first
                first, last, filled = first + n, size, room[size, cell] if n == 1 else most
            out = F.when(here, number).otherwise(out)
        return out.cast("long")

    def facts(t: pa.Table | pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
        norms = (_matrix(t["v"], t.num_rows, np.int64).astype(float) ** 2).sum(axis=1)
        return pivots[size].facts(_matrix(t["far"], t.num_rows), norms), norms

    def ranges(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("size", "ascending"), ("block", "ascending")])
            keys = np.stack([t["size"].to_numpy(), t["block"].to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            out = []
            for a, z in zip(edges, edges[1:], strict=False):
                part = t.slice(a, z - a)
                if z > a and (size := part["size"][0].as_py()) in pivots:
                    f, norms = facts(part, size)
                    low = part["floor"].fill_null(float("-inf")).to_numpy().min()
                    out.append((size, part["block"][0].as_py(), f.min(axis=0).tobytes(), f.max(axis=0).tobytes(), float(norms.max()), float(low)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], ["size", "block", "low", "high", "norm", "floor"])

    def whole(t: pa.Table) -> pa.Table:
        low, high = _matrix(t["low"], t.num_rows).min(axis=0), _matrix(t["high"], t.num_rows).max(axis=0)
        return pa.table({"size": t["size"][:1], "block": t["block"][:1], "low": [low.tobytes()], "high": [high.tobytes()], "norm": [max(t["norm"].to_pylist())], "floor": [min(t["floor"].to_pylist())]}).cast(
            pa.schema([("size", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("norm", pa.float64()), ("floor", pa.float64())])
        )

    again = vectors.select(*(F.col(c).alias(c) for c in vectors.columns))  # columns of its own: the two sides meet below
    left = again.filter("q").withColumn("group", dealt("m", GROUP, 500))
    right = vectors.withColumn("block", dealt("n", BLOCK, 2000))
    shape = ["size", "block", "v", "far", "floor"]
    of_groups, of_blocks = (x.select(*shape).mapInArrow(ranges, _RANGES).groupBy("size", "block").applyInArrow(whole, _RANGES) for x in (left.withColumn("block", F.col("group")), right))
    named = of_groups.select("size", F.col("block").alias("group"), *(F.col(c).alias(f"q_{c}") for c in ("low", "high", "norm", "floor")))

    def reaching(batches):
        for b in batches:
            keep = []
            for size, lo, hi, norm, qlo, qhi, qnorm, floor in zip(*(b.column(c).to_pylist() for c in ("size", "low", "high", "norm", "q_low", "q_high", "q_norm", "q_floor")), strict=True):
                p, (lo, hi, qlo, qhi) = pivots[size], (np.frombuffer(x) for x in (lo, hi, qlo, qhi))
                keep.append(p.range_bound(qlo, qhi, lo, hi) + _slack(qnorm, norm, p) >= floor)
            yield b.select(["size", "block", "group"]).filter(pa.array(keep, pa.bool_()))

    met = named.join(of_blocks, "size").mapInArrow(reaching, "size int, block long, group long")
    if set(r["size"] for r in counts) - set(pivots):  # lengths without pivots: all blocks meet all groups
        bare = ~F.col("size").isin(list(pivots))
        met = met.unionByName(left.filter(bare).select("size", "group").distinct().join(right.filter(bare).select("size", "block").distinct(), "size"))
    met = materialize(met, "block-pairs")
    key = ["size", "block", "group"]
    queries, rows = left.join(met, ["size", "group"]), right.join(met, ["size", "block"])

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            size = queries["size"][0].as_py()
            p = pivots.get(size)
            x, q = (np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(t.num_rows, size) for t in (rows, queries))
            fx, norms = facts(rows, size) if p else (None, None)
            fq, q_norms = facts(queries, size) if p else (None, None)
            at, ids = rows["row"].to_numpy(), rows["id"].to_numpy()
            floors = queries["floor"].fill_null(float("-inf")).to_numpy()
            for a in range(0, len(q), 32):  # bounds of some queries at a time
                some = slice(a, a + 32)
                bound = p.bounds(fq[some], fx) + _slack(q_norms[some, None], norms, p) if p else np.full((len(q[some]), len(x)), np.inf)
                for row, query, floor, v, limit in zip(queries["row"][some].to_pylist(), queries["id"][some].to_pylist(), floors[some], q[some], bound, strict=True):
                    out += [(row, query, i, s) for s, i in search_block(v, limit, floor, row, x, at, ids, k)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("row", "query_id", "vec_id", "score"), cols, strict=True)})

    parts = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id")))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
