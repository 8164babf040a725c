"""Exact dedup with a heavy-hitter split. DataFrame functions only.

1. Every text is normalised and hashed once; the (id, digest) rows go to a scratch table.
2. ``approx_top_k`` sketches (frequent-items sketches of the Misra-Gries family: a bounded
   set of counters that drops the small ones) are built by groups of partitions and then
   combined, so no task merges more than a few hundred sketches.
3. What the sketch proposes is verified: one map-side combined aggregation counts the
   candidates exactly and finds their smallest id. At most ``MAX_HEAVY`` winners come out,
   which bounds what is broadcast.
4. Rows of heavy digests are settled on the map side against the broadcast winners. The
   remaining digests are settled by one shuffle of (digest, id) rows.

``mark_duplicates`` shuffles (id, digest) rows and never a text; ``drop_duplicates`` returns
whole rows and shuffles those that may stay. Groups are reduced by map-side combined
minima and counts and joined back, so none is gathered in a window.

Defined results: null text counts as empty, so all null and empty texts form one group; null
ids sort after all others; of rows that tie on text and id, one stays, in ``drop_duplicates`` the
one with the smallest hash of the whole row. Empty input gives an empty result. Extra columns
are ignored by ``mark_duplicates`` and carried along by ``drop_duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.names import quoted, row_order, unused

from .scratch import materialize

#: Winners broadcast at most, 80 bytes each.
MAX_HEAVY = 1000
#: Counters of one sketch.
COUNTERS = 8192
#: First-level sketch groups.
FAN_IN = 128
#: A verified digest is heavy from so many rows.
MIN_HEAVY = 50


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def frequent_digests(rows: DataFrame, digest: str = "_digest") -> DataFrame:
    """At most MAX_HEAVY candidate digests, from sketches combined in two levels."""
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("_g")).agg(
        F.expr(f"approx_top_k_accumulate({digest}, {COUNTERS})").alias("_s")
    )
    # grouped, if only by one value: an ungrouped combine fails on an empty partition
    whole = parts.groupBy((F.col("_g") >= 0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {COUNTERS})").alias("_s"))
    return (
        whole.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {MAX_HEAVY})")).alias("_c"))
        .filter(F.col("_c.count") >= MIN_HEAVY // 2)
        .select(F.col("_c.item").alias(digest))
    )


def _smallest() -> Column:
    """Order of rows in a group: smallest id first, null ids last, then the row number."""
    return F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def heavy_winners(rows: DataFrame) -> DataFrame:
    """(_digest, _keep, _size) of the verified heavy digests; at most MAX_HEAVY rows.
    ``rows`` has _digest, _id and _row."""
    return (
        rows.join(F.broadcast(frequent_digests(rows)), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.min(_smallest()).alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .filter(F.col("_size") >= MIN_HEAVY)
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(
        docs.select(
            docs[quoted(id_col)].alias("_id"),
            F.monotonically_increasing_id().alias("_row"),
            text_digest(docs[quoted(text_col)]).alias("_digest"),
        ),
        "exact-digests",
    )
    winners = materialize(heavy_winners(rows), "exact-winners")
    heavy = rows.join(F.broadcast(winners), "_digest")
    light = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    groups = light.groupBy("_digest").agg(F.min(_smallest()).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    return heavy.unionByName(light.join(groups, "_digest")).select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Losers of heavy digests are removed on the map side, so only rows that may stay are
    shuffled.
    """
    this, digest, keep, order, n = unused(docs.columns, "_id", "_digest", "_keep", "_order", "_n")
    keyed = docs.withColumns({this: docs[quoted(id_col)], digest: text_digest(docs[quoted(text_col)]), order: row_order(docs)})
    skinny = materialize(
        keyed.select(F.col(this).alias("_id"), F.col(digest).alias("_digest"), F.monotonically_increasing_id().alias("_row")),
        "exact-digests",
    )
    winners = materialize(heavy_winners(skinny), "exact-winners")
    best = winners.select(F.col("_digest").alias(digest), F.col("_keep.id").alias(keep))
    left = keyed.join(F.broadcast(best), digest, "left").filter(F.col(keep).isNull() | F.col(this).eqNullSafe(F.col(keep)))
    # the row limit is applied on the map side before the shuffle and again after it
    first = F.row_number().over(Window.partitionBy(digest).orderBy(F.col(this).asc_nulls_last(), order))
    return left.withColumn(n, first).filter(F.col(n) == 1).select(*map(quoted, docs.columns))
