"""Not-modified revisits resolved by an as-of join.

A crawl stores a full response once; later "304 Not Modified" captures of the same address
hold headers alone. For each such revisit the operator finds the latest earlier full
response of the same canonical address, checks the validators (entity tag and modification
date), and merges the headers that a 304 may update over those of the response.

The join is a union of both kinds and a running ``last``, in two levels so that an address
with a third of all captures isn't one window: captures are cut into time buckets, the last
response of each (address, bucket) is carried forward over buckets, and the running ``last``
runs within a bucket. A bucket with many captures is cut again, by their number.

Defined results: a full response resolves to itself. A revisit without an earlier response
has status ``missing``; a null address or time has status ``invalid``. Of captures at one
time a response comes before a revisit; of tied responses the one with the largest id
counts. A validator is compared only where both sides have it: one that differs gives
``stale``, none to compare gives ``unchecked``, else ``resolved``. Only resolved revisits get a
source, a digest and merged headers; ``trust_unchecked`` grants them to unchecked ones too. An
empty table gives an empty result; repeated captures are each resolved; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.history import with_time_bucket

from .scratch import materialize

#: Headers of a 304 that replace the stored ones (those that describe the cached response).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that never select content, and host prefixes that don't tell sites apart.
TRACKING, PREFIXES = r"utm_[a-z]+|gclid|fbclid", r"www\."


def canonical_url(url: Column, tracking: str = TRACKING, prefixes: str = PREFIXES) -> Column:
    """Address without scheme, ``www.``, default port, fragment, tracking parameters, index page
    or closing slash; host in lower case, parameters in order."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), f"^({prefixes})", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({tracking})(=|$)"))
    tail = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def entity_tag(tag: Column) -> Column:
    """Weak comparison: without the weakness mark and the quotes."""
    return F.regexp_replace(F.trim(tag), r'^W/|"', "")


def resolve_revisits(captures: DataFrame, bucket: int = 86_400, most: int = 100_000, trust_unchecked: bool = False) -> DataFrame:
    """``captures``: record_id long, url string, ts long (seconds), kind 'response' or
    'revisit', etag, last_modified, headers map<string,string>, digest string. Returns for
    each capture: record_id, url_key, ts, kind, source_id, status, digest, headers."""
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind",
        F.struct(F.col("record_id").alias("id"), entity_tag(F.col("etag")).alias("etag"), F.col("last_modified").alias("date"), "headers", "digest").alias("_own"),
    )
    rows = materialize(rows, "captures")  # addresses and digests are made once, and read several times
    valid = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    good = with_time_bucket(rows.filter(valid), ["url_key"], "ts", bucket, most, "_bucket")
    full = F.when(F.col("kind") == "response", F.col("_own"))
    by_time = F.struct("ts", "record_id")
    lasts = good.filter("kind = 'response'").groupBy("url_key", "_bucket").agg(F.max_by("_own", by_time).alias("_last"))
    present = good.select("url_key", "_bucket").distinct().join(lasts, ["url_key", "_bucket"], "left")
    over = Window.partitionBy("url_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = present.withColumn("_before", F.last("_last", ignorenulls=True).over(over)).select("url_key", "_bucket", "_before")
    within = Window.partitionBy("url_key", "_bucket").orderBy("ts", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    at = good.withColumn("_inside", F.last(full, ignorenulls=True).over(within)).join(carried, ["url_key", "_bucket"])
    at = at.withColumn("_src", F.coalesce("_inside", "_before")).drop("_inside", "_before", "_bucket")
    bad = rows.filter(~valid).withColumn("_src", F.when(F.lit(False), F.col("_own")))
    out = at.unionByName(bad)

    own, src, revisit = F.col("_own"), F.col("_src"), F.col("kind") == "revisit"
    differs = F.coalesce(own["etag"] != src["etag"], F.lit(False)) | F.coalesce(own["date"] != src["date"], F.lit(False))
    checked = (own["etag"].isNotNull() & src["etag"].isNotNull()) | (own["date"].isNotNull() & src["date"].isNotNull())
    status = (
        F.when(F.col("url_key").isNull() | F.col("ts").isNull(), "invalid")
        .when(~revisit, "full").when(src.isNull(), "missing").when(differs, "stale").when(~checked, "unchecked").otherwise("resolved")
    )
    empty = F.create_map().cast("map<string,string>")

    def lower(m: Column) -> Column:  # of names that differ in case alone the last counts
        pairs = F.transform(F.map_entries(F.coalesce(m, empty)), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
        names = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
        return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda e: e["k"] == k), -1)["v"]))

    new = F.map_filter(lower(own["headers"]), lambda k, v: k.isin(*PERMITTED))
    old = lower(src["headers"])
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    out = out.withColumn("status", status)
    hit = revisit & F.col("status").isin("resolved", *(["unchecked"] if trust_unchecked else []))
    return out.select(
        "record_id", "url_key", "ts", "kind",
        F.when(~revisit, F.col("record_id")).when(hit, src["id"]).alias("source_id"), "status",
        F.when(~revisit, own["digest"]).when(hit, src["digest"]).alias("digest"),
        F.when(hit, merged).otherwise(lower(own["headers"])).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log from a table of fetched pages. Each page is one full response and one
    revisit of the same address a day later; where another page of the address was fetched
    in between, the revisit finds that one. By page number some revisits name no validator,
    one of another version, a modification date instead of a tag, or come before any
    response; some have no time or no address."""
    n, kind = F.col("page_id"), F.col("page_id") % 12
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day, none = n * 600, F.lit(None).cast("string")
    date = F.concat(F.lit("day "), day.cast("string"))
    response = pages.select(
        (n * 2).alias("record_id"), "url", digest.alias("digest"), day.alias("ts"), F.lit("response").alias("kind"), F.when(kind != 3, tag).alias("etag"),
        F.when(kind.isin(3, 4), date).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), day.cast("string")).alias("headers"),
    )
    later = F.when(kind == 5, F.lit(-1)).when(kind == 6, F.lit(None)).otherwise(day + 86_400).cast("long")
    told = F.when(kind == 1, none).when(kind == 2, F.lit('"other"')).when(kind == 3, none).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (n * 2 + 1).alias("record_id"), F.when(kind != 7, F.col("url")).alias("url"), digest.alias("digest"), later.alias("ts"), F.lit("revisit").alias("kind"), told.alias("etag"),
        F.when(kind == 3, date).alias("last_modified"),
        F.create_map(F.lit("ETag"), tag, F.lit("Date"), (day + 86_400).cast("string"), F.lit("Set-Cookie"), F.lit("x=1")).alias("headers"),
    )
    return response.unionByName(revisit)
