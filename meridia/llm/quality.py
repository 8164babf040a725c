"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of byte classes, word lengths, repetition, symbols)
are binned into at most ``BINS`` quantile bins. Trees of depth ``DEPTH`` are grown from
histograms of gradients over bins and flattened into arrays, so that scoring walks all
rows of a batch down one tree with a few numpy operations.

The trees are fitted on a sample of at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id, so a fit costs the same for any corpus. Statistics and scores
are computed for every document. One scan for the sample, one for the scores, no shuffle
of texts.

Defined results: null text counts as empty and is scored like any other text; rows with a
null label or id teach nothing; a repeated id is scored each time; without labels of both
kinds every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result; extra columns are ignored by ``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridia.functions.names import quoted

from .scratch import bound_batches

SAMPLE, BINS, DEPTH, TREES, RATE, L2, LEAST = 20_000, 48, 4, 60, 0.2, 1.0, 8
THRESHOLD = 0.3

_byte = np.arange(256)
_CLASSES = np.stack(
    [
        (_byte >= 65) & (_byte <= 90),  # upper case
        (_byte >= 97) & (_byte <= 122),  # lower case
        (_byte >= 48) & (_byte <= 57),
        _byte >= 128,
        np.isin(_byte, [9, 10, 11, 12, 13, 32]),
        _byte == 10,
        np.isin(_byte, list(b".,;:'\"-()?")),
        _byte == ord("!"),
        _byte == ord("|"),
        np.isin(_byte, list(b"#$%&*+<=>@[]^_`{}~\\/")),
        _byte < 9,
    ],
    axis=1,
).astype(np.float64)
N_FEATURES = _CLASSES.shape[1] + 16


def statistics(text: str | None) -> list[float]:
    """The document's statistics; all finite, also for the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n).tolist()
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = list(map(len, words))
    mean = sum(lengths) / m
    twice = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    fours = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    lines = raw.split(b"\n")
    letters = shares[0] + shares[1] + shares[3]
    ends = [w[-1] for w in words]
    return [
        *shares,
        math.log1p(len(raw)),
        math.log1p(len(words)),
        mean,
        math.sqrt(max(0.0, sum(x * x for x in lengths) / m - mean * mean)),
        max(lengths, default=0) / n,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        twice / m,
        pairs / max(1, len(words) - 1),
        fours / max(1, len(words) - 3),
        len(set(lines)) / len(lines),
        shares[0] / letters if letters else 0.0,
        sum(1 for w in words if w.isalpha() is False and len(w) < 3) / m,
        sum(1 for e in ends if e in b"#$%&*!|") / m,
        sum(1 for w in words if len(w) <= 3) / m,
        len(zlib.compress(raw, 1)) / n if len(raw) > 64 else 1.0,
    ]


def features(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


@dataclass(frozen=True)
class Trees:
    """Full binary trees in arrays. Inner node k of a tree has children 2k + 1 and 2k + 2; a
    node that isn't split sends all rows left."""

    edges: list[np.ndarray]  # upper bounds of each feature's bins
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # largest bin that goes left
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            b, rows, depth = self.bins(x), np.arange(len(x)), int(math.log2(self.leaf.shape[1]))
            for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
                node = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (b[rows, feature[node]] > bound[node])
                total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts depth-wise trees on the logistic loss."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Trees(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int16), np.zeros((0, leaves)), math.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    width, n_feat = BINS + 1, x.shape[1]
    flat = b + np.arange(n_feat) * width  # one cell for each feature and bin
    total = np.full(len(y), model.base)
    grown = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, width, np.int16)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * (n_feat * width) + flat).ravel()
            shape = (many, n_feat, width)
            g, h, c = (np.bincount(cell, np.repeat(v, n_feat), many * n_feat * width).reshape(shape).cumsum(axis=2) for v in (grad, hess, np.ones(len(y))))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(c < LEAST) | (ct - c < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            feature[first : first + many] = best // width
            bound[first : first + many] = np.where(split, best % width, width)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > bound[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + L2)
        total += leaf[at]
        grown.append((feature, bound, leaf))
    f, t, v = (np.stack(part) for part in zip(*grown, strict=True))
    return Trees(edges, f, t, v, model.base)


def held_out(id_col: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fits on at most ``sample`` rows: the labelled, not held out ones of smallest hash. Of
    documents that share an id the text of smallest hash teaches."""
    bound_batches(docs.sparkSession)
    taught = labels.filter(labels[id_col].isNotNull() & labels[label_col].isNotNull() & ~held_out(labels[id_col]))
    chosen = taught.select(taught[id_col].alias("_id"), taught[label_col].cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_y").limit(sample)
    chosen = chosen.groupBy("_id", "_y").agg(F.count(F.lit(1)).alias("_n"))
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_h"))
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_y", "_n", "_h", "_text")

    def run(batches):
        best: dict = {}  # of each sampled id in this task: smallest hash and its features
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            new = {}
            for at, (key, h) in enumerate(zip(keys, b.column(3).to_pylist(), strict=True)):
                if key not in best or h < best[key][0]:
                    best[key], new[key] = (h, None), at
            if new:
                for (key, at), x in zip(new.items(), features(b.column(4).take(pa.array(new.values(), pa.int64()))), strict=True):
                    best[key] = (best[key][0], x)
        if best:
            ids, y, n = zip(*best, strict=True)
            h, x = zip(*best.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "n", "h", "x"])

    field = joined.schema["_doc"].dataType
    kind_of = to_arrow_type(field)
    each = joined.mapInArrow(run, f"id {field.simpleString()}, y int, n long, h long, x array<double>")
    rows = each.groupBy("id", "y", "n").agg(F.min(F.struct("h", "x")).alias("m")).select("y", "n", "m.x").toArrow()
    n = rows["n"].to_numpy()  # a repeated label teaches each time
    y = np.repeat(np.array(rows["y"].to_pylist(), np.float64), n)
    x = np.repeat(np.array(rows["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES), n, axis=0)
    order = np.lexsort([*x.T, y])  # the same model whatever order rows come in
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(features(b.column(2))))], ["doc_id", "held_out", "score"])

    bound_batches(docs.sparkSession)
    key = docs[quoted(id_col)]
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), docs[quoted(text_col)].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score the threshold at least, with all their columns. One scan."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = model.score(features(b.column(at))) >= threshold
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
